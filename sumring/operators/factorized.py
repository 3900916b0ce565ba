"""Statistics over joins without the join's rows: sums travel up a join tree, aggregated before each join.

``JoinTree`` starts at the fact table; each step joins a dimension and may regroup to the keys still needed. A dimension whose key is
unique is not aggregated itself, as that would not shrink it. Products of the ring are plain arithmetic on sums: counts scale the
other side's sums, sums multiply for cross products.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cofactor import Cofactor


@dataclass
class Step:
    """Join ``dim`` on columns ``on``, adding its continuous and categorical columns; then keep only ``keys`` for later joins."""

    dim: DataFrame
    on: list[str]
    cont: list[str] = field(default_factory=list)
    cat: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    regroup: bool = False


@dataclass
class JoinTree:
    fact: DataFrame
    cont: list[str]
    cat: list[str]
    keys: list[str]
    steps: list[Step]

    def joined(self) -> DataFrame:
        """The join itself, for comparison."""
        out = self.fact
        for s in self.steps:
            out = out.join(s.dim, s.on)
        return out


#: Rows of the fact table for each of its keys from which sums are taken below the join.
SHRINK = 4


def _pair(a: str, b: str) -> str:
    return f"q_{min(a, b)}__{max(a, b)}"


def partial_sums(tree: JoinTree) -> tuple[DataFrame, list[str], list[str]]:
    """Rows of (categories, n, s_x, q_x__y) whose sums are the statistics of the join; with all continuous and categorical names."""
    cont, cat = list(tree.cont), list(tree.cat)
    x = {c: F.col(c).cast("double") for c in cont}
    agg = [F.count(F.lit(1)).alias("n"), *(F.sum(x[c]).alias(f"s_{c}") for c in cont)]
    agg += [F.sum(x[a] * x[b]).alias(_pair(a, b)) for i, a in enumerate(cont) for b in cont[i:]]
    observed = tree.fact.dropna(subset=[*cont, *cat]) if cont or cat else tree.fact
    rows = observed.groupBy(*tree.keys, *cat).agg(*agg)
    for step in tree.steps:
        dim = step.dim.dropna(subset=[*step.cont, *step.cat]) if step.cont or step.cat else step.dim
        rows = rows.join(dim.select(*step.on, *step.cont, *step.cat, *(k for k in step.keys if k in dim.columns and k not in step.on)), step.on)
        new = {}
        for i, d in enumerate(step.cont):
            v = F.col(d).cast("double")
            new[f"s_{d}"] = F.col("n") * v
            new |= {_pair(d, e): F.col("n") * v * F.col(e).cast("double") for e in step.cont[i:]}
            new |= {_pair(c, d): F.col(f"s_{c}") * v for c in cont}
        rows = rows.withColumns(new) if new else rows
        cont, cat = cont + step.cont, cat + step.cat
        sums = ["n", *(f"s_{c}" for c in cont), *(_pair(a, b) for i, a in enumerate(cont) for b in cont[i:])]
        if step.regroup:
            rows = rows.groupBy(*step.keys, *cat).agg(*(F.sum(c).alias(c) for c in sums))
        else:
            rows = rows.select(*dict.fromkeys([*step.keys, *cat, *sums]))
    return rows, cont, cat


def train(tree: JoinTree, label: str, strategy: str = "auto", lam: float = 0.0):
    """Ridge regression of ``label`` over a join: ``materialized`` writes the join and scans it, ``joined`` aggregates over it, ``factorized``
    aggregates below it. ``auto`` goes below the join if the fact table's keys say that this shrinks it (``SHRINK`` rows a key)."""
    from .cofactor import cofactor
    from .lineage import cut
    from .models import ridge

    cont, cat = [*tree.cont, *(c for s in tree.steps for c in s.cont)], [*tree.cat, *(c for s in tree.steps for c in s.cat)]
    if strategy == "auto":
        rows, keys = tree.fact.agg(F.count("*"), F.approx_count_distinct(F.struct(*tree.keys))).first()
        strategy = "factorized" if rows >= SHRINK * max(1, keys) else "joined"
    if strategy == "factorized":
        return ridge(factorized_cofactor(tree), label, lam)
    if strategy not in ("joined", "materialized"):
        raise ValueError("strategy is one of auto, materialized, joined, factorized")
    rows = tree.joined().select(*cont, *cat)
    return ridge(cofactor(cut(rows) if strategy == "materialized" else rows, cont, cat), label, lam)


def factorized_sums(tree: JoinTree) -> DataFrame:
    """One row: n, s_x, q_x__y of the join."""
    rows, cont, _ = partial_sums(tree)
    sums = ["n", *(f"s_{c}" for c in cont), *(_pair(a, b) for i, a in enumerate(cont) for b in cont[i:])]
    return rows.agg(*(F.sum(c).alias(c) for c in sums))


#: Categorical columns up to which sums are grouped by all of them at once.
JOINT = 2


def _only(tree: JoinTree, cont: bool, cats: tuple[str, ...]) -> JoinTree:
    """The tree with the categorical columns ``cats`` alone, and with or without the continuous ones."""
    some = lambda cs: [c for c in cs if c in cats]
    steps = [Step(s.dim, s.on, s.cont if cont else [], some(s.cat), s.keys, s.regroup) for s in tree.steps]
    return JoinTree(tree.fact, tree.cont if cont else [], some(tree.cat), tree.keys, steps)


def _sums_of(rows: DataFrame, cont: list[str], by: tuple[str, ...]) -> list:
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(f"s_{c}").alias(f"s_{c}") for c in cont)).collect()


def factorized_cofactor(tree: JoinTree) -> Cofactor:
    """The statistics of the join. With more than ``JOINT`` categorical columns the sums for each of them, and for each pair, go up the tree
    apart: the ring needs no more than pairs, and groups of all columns jointly would not shrink the fact table. Rows with a null among a
    dimension's features do not count."""
    every_cat = [*tree.cat, *(c for s in tree.steps for c in s.cat)]
    clean = [Step(s.dim.dropna(subset=[*s.cont, *s.cat]) if s.cont or s.cat else s.dim, s.on, s.cont, s.cat, s.keys, s.regroup) for s in tree.steps]
    tree = JoinTree(tree.fact.dropna(subset=[*tree.cont, *tree.cat]) if tree.cont or tree.cat else tree.fact, tree.cont, tree.cat, tree.keys, clean)
    joint = len(every_cat) <= JOINT
    rows, cont, _ = partial_sums(tree if joint else _only(tree, True, ()))
    sums = ["n", *(f"s_{c}" for c in cont), *(_pair(a, b) for i, a in enumerate(cont) for b in cont[i:])]
    out = Cofactor(cont, every_cat)
    r = rows.agg(*(F.sum(c).alias(c) for c in sums)).first()
    out.n = float(r["n"] or 0)
    for i, a in enumerate(cont):
        out.lin[i] = r[f"s_{a}"] or 0.0
        for j, b in enumerate(cont):
            out.quad[i, j] = r[_pair(a, b)] or 0.0
    for c in every_cat:
        for r in _sums_of(rows if joint else partial_sums(_only(tree, True, (c,)))[0], cont, (c,)):
            out.lin_cat[c][r[c]] = float(r["n"])
            for x in cont:
                out.num_cat[x, c][r[c]] = r[f"s_{x}"]
    for pair in combinations(every_cat, 2):
        for r in _sums_of(rows if joint else partial_sums(_only(tree, False, pair))[0], [], pair):
            out.cat_cat[pair][r[pair[0]], r[pair[1]]] = float(r["n"])
    return out
