"""Sufficient statistics of a table: computed by DataFrame aggregation, held as a small driver-side ring value.

``cofactor`` picks the physical form: native SUMs for few continuous columns (partial and final hash aggregation, whole-stage code),
a Gram kernel over Arrow batches beyond ``NATIVE`` columns (one small matrix leaves each task), and one GROUPING SETS aggregation for
everything categorical. Only sums, of a size set by columns and categories, ever reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Continuous columns up to which native SUM expressions are used.
NATIVE = 12
#: Columns of the one-hot expansion up to which its matrix (8 bytes a cell) is built on the driver.
EXPANDED = 10_000


@dataclass
class Cofactor:
    """n, sums, matrix of products; lin_cat[c][k] counts, num_cat[x, c][k] sums, cat_cat[c, d][k, l] counts (c before d)."""

    cont: list[str]
    cat: list[str]
    n: float = 0.0
    lin: np.ndarray = None
    quad: np.ndarray = None
    lin_cat: dict = field(default_factory=dict)
    num_cat: dict = field(default_factory=dict)
    cat_cat: dict = field(default_factory=dict)

    def __post_init__(self):
        k = len(self.cont)
        self.lin = np.zeros(k) if self.lin is None else np.asarray(self.lin, float)
        self.quad = np.zeros((k, k)) if self.quad is None else np.asarray(self.quad, float)
        for c in self.cat:
            self.lin_cat.setdefault(c, {})
            for x in self.cont:
                self.num_cat.setdefault((x, c), {})
        for c, d in combinations(self.cat, 2):
            self.cat_cat.setdefault((c, d), {})

    def _with(self, other: Cofactor, sign: int) -> Cofactor:
        if not other.cont and not other.cat and not other.n:
            return self  # an empty operand
        if not self.cont and not self.cat and not self.n and sign > 0:
            return other
        if (self.cont, self.cat) != (other.cont, other.cat):
            raise ValueError("columns differ")

        def maps(a: dict, b: dict) -> dict:
            return {k: {key: a[k].get(key, 0.0) + sign * b[k].get(key, 0.0) for key in a[k].keys() | b[k].keys()} for k in a}

        return Cofactor(self.cont, self.cat, self.n + sign * other.n, self.lin + sign * other.lin, self.quad + sign * other.quad, maps(self.lin_cat, other.lin_cat), maps(self.num_cat, other.num_cat), maps(self.cat_cat, other.cat_cat))

    def __add__(self, other: Cofactor) -> Cofactor:
        return self._with(other, 1)

    def __sub__(self, other: Cofactor) -> Cofactor:
        return self._with(other, -1)

    def __mul__(self, other: Cofactor) -> Cofactor:
        """The value of a cross product of two tables with different columns."""
        if set(self.cont + self.cat) & set(other.cont + other.cat):
            raise ValueError("columns overlap")
        a, b, scale = self, other, lambda m, k: {key: v * k for key, v in m.items()}
        out = Cofactor(a.cont + b.cont, a.cat + b.cat, a.n * b.n, np.concatenate([a.lin * b.n, b.lin * a.n]), np.block([[a.quad * b.n, np.outer(a.lin, b.lin)], [np.outer(b.lin, a.lin), b.quad * a.n]]))
        for v, w in ((a, b), (b, a)):
            for c in v.cat:
                out.lin_cat[c] = scale(v.lin_cat[c], w.n)
                for x in v.cont:
                    out.num_cat[x, c] = scale(v.num_cat[x, c], w.n)
                for i, x in enumerate(w.cont):
                    out.num_cat[x, c] = scale(v.lin_cat[c], w.lin[i])
            for pair in combinations(v.cat, 2):
                out.cat_cat[pair] = scale(v.cat_cat[pair], w.n)
        for c in a.cat:
            for d in b.cat:
                out.cat_cat[c, d] = {(k, m): x * y for k, x in a.lin_cat[c].items() for m, y in b.lin_cat[d].items()}
        return out

    def categories(self, cat: str) -> list:
        return sorted(k for k, v in self.lin_cat[cat].items() if v)

    def layout(self, drop_first: bool = False, skip: str | None = None, categories: dict | None = None) -> list[tuple]:
        """Names of the one-hot expansion: ("1",), (x,) for continuous, (c, k) for categories in sorted order."""
        names: list[tuple] = [("1",), *((x,) for x in self.cont if x != skip)]
        for c in self.cat:
            if c != skip:
                names += [(c, k) for k in (categories or {}).get(c, self.categories(c))[1 if drop_first else 0 :]]
        return names

    def entry(self, a: tuple, b: tuple) -> float:
        """Sum over rows of the product of two expanded columns."""
        if len(a) > len(b) or (len(a) == 1 and a != ("1",) and b == ("1",)):
            a, b = b, a
        if a == ("1",):
            return self.n if b == ("1",) else self.lin[self.cont.index(b[0])] if len(b) == 1 else self.lin_cat[b[0]].get(b[1], 0.0)
        if len(b) == 1:
            return self.quad[self.cont.index(a[0]), self.cont.index(b[0])]
        if len(a) == 1:
            return self.num_cat[a[0], b[0]].get(b[1], 0.0)
        if a[0] == b[0]:
            return self.lin_cat[a[0]].get(a[1], 0.0) if a[1] == b[1] else 0.0
        if (a[0], b[0]) not in self.cat_cat:
            a, b = b, a
        return self.cat_cat[a[0], b[0]].get((a[1], b[1]), 0.0)

    def sigma(self, drop_first: bool = False, skip: str | None = None) -> tuple[list[tuple], np.ndarray]:
        """The expanded matrix Z'Z with its names."""
        names = self.layout(drop_first, skip)
        if len(names) > EXPANDED:
            raise ValueError(f"the expansion has {len(names)} columns; a matrix on the driver may have {EXPANDED}")
        at = {name: i for i, name in enumerate(names)}
        lead = [i for i, name in enumerate(names) if len(name) == 1]  # the constant and the continuous columns
        out = np.zeros((len(names), len(names)))
        for i in lead:
            for j in lead:
                out[i, j] = self.entry(names[i], names[j])
        for c, counts in self.lin_cat.items():
            for k, v in counts.items():
                if (c, k) in at:
                    out[at[c, k], at[c, k]] = out[0, at[c, k]] = out[at[c, k], 0] = v
        for (x, c), sums in self.num_cat.items():
            if (x,) in at:
                for k, v in sums.items():
                    if (c, k) in at:
                        out[at[x,], at[c, k]] = out[at[c, k], at[x,]] = v
        for (c, d), counts in self.cat_cat.items():
            for (k, m), v in counts.items():
                if (c, k) in at and (d, m) in at:
                    out[at[c, k], at[d, m]] = out[at[d, m], at[c, k]] = v
        return names, out

    def class_sums(self, label: str, drop_first: bool = False) -> tuple[list, list[tuple], np.ndarray]:
        """Per category of ``label``, the sums of all other expanded columns."""
        names = self.layout(drop_first, label)
        classes = self.categories(label)
        return classes, names, np.array([[self.entry(a, (label, k)) for a in names] for k in classes]).reshape(len(classes), len(names))

    def stats(self) -> dict:
        """Number of entries of the relations: total, mean, deviation, least, most."""
        sizes = [len(m) for group in (self.lin_cat, self.num_cat, self.cat_cat) for m in group.values()]
        return {"total": sum(sizes), "mean": float(np.mean(sizes)) if sizes else 0.0, "stddev": float(np.std(sizes)) if sizes else 0.0, "min": min(sizes, default=0), "max": max(sizes, default=0)}


def _observed(df: DataFrame, columns: list[str]) -> DataFrame:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def sum_expressions(cont: list[str]) -> list[Column]:
    """Count, sums and sums of products as native aggregates: n, s_i, q_i_j (i <= j)."""
    x = [F.col(c).cast("double") for c in cont]
    out = [F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"s_{i}") for i, v in enumerate(x))]
    return out + [F.sum(x[i] * x[j]).alias(f"q_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]


def _from_sums(row, cont: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    k = len(cont)
    quad = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            quad[i, j] = quad[j, i] = row[f"q_{i}_{j}"] or 0.0
    return float(row["n"] or 0), np.array([row[f"s_{i}"] or 0.0 for i in range(k)]), quad


def gram(df: DataFrame, cont: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, i, j, v): sums of products of the columns extended by a constant 1 at index 0, each task sending one matrix per group."""
    by = by or []

    def run(it):
        import pandas as pd

        total: dict = {}
        for pdf in it:
            for key, part in pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]:
                x = np.column_stack([np.ones(len(part)), part[cont].to_numpy(float)])
                total[key] = total.get(key, 0) + x.T @ x
        i, j = np.triu_indices(len(cont) + 1)
        for key, m in total.items():
            yield pd.DataFrame({**dict(zip(by, key, strict=True)), "i": i, "j": j, "v": m[i, j]})

    fields = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in by), "i int, j int, v double"])
    wide = df.select(*by, *(F.col(c).cast("double").alias(c) for c in cont))
    return wide.mapInPandas(run, fields).groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def categorical_sums(df: DataFrame, cont: list[str], cat: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, cats, n, s_i): counts and sums by category and by pair of categories, in one GROUPING SETS aggregation; columns outside a set
    are null and ``_gid`` is its grouping number."""
    by = by or []
    sets = [[F.col(x) for x in [*by, *s]] for s in [*((c,) for c in cat), *combinations(cat, 2)]]
    agg = [F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(cont))]
    return df.groupingSets(sets, *by, *cat).agg(F.grouping_id().alias("_gid"), *agg)


def cofactor(df: DataFrame, cont: list[str], cat: list[str] | None = None, strategy: str = "auto") -> Cofactor:
    """Statistics over the rows of ``df`` that have no null among the columns; an empty table gives the ring's zero."""
    cat = cat or []
    rows = _observed(df, [*cont, *cat]).select(*cont, *cat)
    out = Cofactor(list(cont), list(cat))
    if strategy == "gram" or (strategy == "auto" and len(cont) > NATIVE):
        m = np.zeros((len(cont) + 1, len(cont) + 1))
        for r in gram(rows, cont).collect():
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
        out.n, out.lin, out.quad = float(m[0, 0]), m[0, 1:], m[1:, 1:]
    else:
        out.n, out.lin, out.quad = _from_sums(rows.agg(*sum_expressions(cont)).first(), cont)
    if cat:
        for r in categorical_sums(rows, cont, cat).collect():
            in_set = [c for i, c in enumerate(cat) if not r["_gid"] >> (len(cat) - 1 - i) & 1]
            if len(in_set) == 1:
                c, k = in_set[0], r[in_set[0]]
                out.lin_cat[c][k] = float(r["n"])
                for i, x in enumerate(cont):
                    out.num_cat[x, c][k] = r[f"s_{i}"]
            else:
                out.cat_cat[tuple(in_set)][r[in_set[0]], r[in_set[1]]] = float(r["n"])
    return out


def cofactor_by(df: DataFrame, label: str, cont: list[str], cat: list[str] | None = None) -> dict:
    """One value per category of ``label``."""
    cat = cat or []
    rows = _observed(df, [label, *cont, *cat])
    out = {}
    for r in rows.groupBy(label).agg(*sum_expressions(cont)).collect():
        out[r[label]] = Cofactor(list(cont), list(cat), *_from_sums(r, cont))
    if cat:
        for r in categorical_sums(rows, cont, cat, [label]).collect():
            v, g = out[r[label]], r["_gid"]
            in_set = [c for i, c in enumerate(cat) if not g >> (len(cat) - 1 - i) & 1]
            if len(in_set) == 1:
                c, k = in_set[0], r[in_set[0]]
                v.lin_cat[c][k] = float(r["n"])
                for i, x in enumerate(cont):
                    v.num_cat[x, c][k] = r[f"s_{i}"]
            else:
                v.cat_cat[tuple(in_set)][r[in_set[0]], r[in_set[1]]] = float(r["n"])
    return dict(sorted(out.items()))
