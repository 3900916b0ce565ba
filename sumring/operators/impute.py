"""Missing values: fills, null patterns, and chained-equation imputation (MICE) in four physical strategies.

All strategies give the same values when noise is off; they differ in what they scan and write. ``baseline`` aggregates the observed rows
anew for each column and rewrites the table. The others split the table once by null pattern and rewrite only the patterns in which the
column is missing; complete rows are never written again. ``delta`` keeps the statistics of all rows and takes out, then puts back, what the
column's missing rows contribute. ``reverse`` keeps those of complete rows fixed and adds the observed among incomplete rows.
``factorized`` is ``delta`` over a fact table whose other features are in dimensions: statistics go up a join tree, and only rows to be
imputed look their dimensions up. Values change by projection (``when(is_null, prediction)``), so no row id is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cofactor import Cofactor, cofactor
from .factorized import JoinTree, Step, factorized_cofactor
from .lineage import Parts, cut
from .models import lda, ridge

FLAG = "{}_is_null"


def flag(c: str) -> str:
    return FLAG.format(c)


def fill_values(df: DataFrame, cont: list[str], cat: list[str]) -> dict:
    """Mean of each continuous, least mode of each categorical column, over all rows of the table. Modes come from grouped counts, so that no
    buffer holds all values of a column."""
    row = df.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in cont)).first() if cont else {}
    out = {c: row[c] for c in cont}
    for c in cat:
        top = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_k")).orderBy(F.col("_k").desc(), F.col(c)).first()
        out[c] = top[c] if top else None
    return out


def null_count(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns], F.lit(0))


def null_column_id(columns: list[str]) -> Column:
    """1-based number of the first null column, 0 if there is none."""
    out = F.lit(0)
    for i, c in reversed(list(enumerate(columns, 1))):
        out = F.when(F.col(c).isNull(), i).otherwise(out)
    return out


def null_bucket(columns: list[str], reverse: bool = False) -> Column:
    """Partition by null pattern: '0' none, 'one:<column>', 'some', 'all'; by observed columns if ``reverse``. One column has no 'all'
    apart from 'one', two have no 'some'."""
    n, k = null_count(columns), len(columns)
    count = F.lit(k) - n if reverse else n
    single = F.lit(None).cast("string")
    for c in columns:
        single = F.when(F.col(c).isNotNull() if reverse else F.col(c).isNull(), F.lit(f"one:{c}")).otherwise(single)
    return F.when(count == 0, "0").when(count == k, "all").when(count == 1, single).otherwise("some")


def prepare(df: DataFrame, cont: list[str], cat: list[str]) -> DataFrame:
    """Flags for each column that may be null, the null count, and initial fills."""
    columns = [*cont, *cat]
    out = df.withColumns({flag(c): F.col(c).isNull() for c in columns} | {"null_cnt": null_count(columns), "null_col_id": null_column_id(columns)})
    values = fill_values(df, cont, cat)
    return out.withColumns({c: F.coalesce(F.col(c).cast("double") if c in cont else F.col(c), F.lit(values[c])) for c in columns})


def uniform(keys: list[str], salt: str, seed: int) -> Column:
    """A uniform number in (0, 1) from the row's keys: the same on any cluster and after any retry."""
    h = F.xxhash64(*[F.col(k) for k in keys], F.lit(salt), F.lit(seed))
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(keys: list[str], salt: str, seed: int) -> Column:
    """Box-Muller from two such numbers."""
    import math

    return F.sqrt(-2 * F.log(uniform(keys, salt + "/r", seed))) * F.cos(2 * math.pi * uniform(keys, salt + "/a", seed))


STRATEGIES = ("baseline", "delta", "reverse", "factorized")


def mice(df: DataFrame, cont: list[str], cat: list[str], cont_null: list[str], cat_null: list[str], strategy: str = "baseline", iterations: int = 1, lam: float = 0.0,
         shrinkage: float = 0.0, order: str = "cat_first", noise_keys: list[str] | None = None, seed: int = 0, steps: list[Step] | None = None, on_train: Callable | None = None) -> DataFrame:
    """``df`` with the nulls of ``cont_null`` and ``cat_null`` replaced; the other feature columns must have none.

    Rows in which every listed column is null are left out of training and imputed last in each round, column by column. Noise of the
    model's residual variance is added to continuous predictions if ``noise_keys`` names the columns it is drawn from. ``on_train`` is
    called with (column, statistics, current rows). Extra columns pass through. ``steps`` (for ``factorized`` only) join the dimensions that
    hold the features which ``df`` has not; their keys are unique, and rows without a partner keep the fill.
    """
    if strategy not in STRATEGIES or (strategy == "factorized") != bool(steps):
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}; steps go with factorized")
    targets = [*cat_null, *cont_null] if order == "cat_first" else [*cont_null, *cat_null]
    k, names = len(targets), df.columns
    if steps:
        keys = list(dict.fromkeys(c for s in steps for c in s.on if c in names))
        own = ([c for c in cont if c in names], [c for c in cat if c in names])
        stat = lambda r: factorized_cofactor(JoinTree(r.select(*dict.fromkeys([*keys, *own[0], *own[1]])), *own, keys, steps))
    else:
        stat = lambda r: cofactor(r, cont, cat)

    def imputed(r: DataFrame, changes: list[tuple[str, Column]]) -> DataFrame:
        before = r.columns
        for s in steps or []:
            r = r.join(s.dim.select(*dict.fromkeys([*s.on, *s.cont, *s.cat, *(c for c in s.keys if c in s.dim.columns)])), s.on, "left")
        for c, predicted in changes:
            r = r.withColumn(c, F.when(F.col(flag(c)), F.coalesce(predicted, F.col(c))).otherwise(F.col(c)))
        return r.select(*before)

    def model_column(c: str, value: Cofactor, salt: str) -> Column:
        if value.n == 0:
            return F.col(c)
        if c in cont_null:
            return ridge(value, c, lam).predict(normal(noise_keys, salt, seed) if noise_keys else None)
        return lda(value, c, shrinkage).predict().cast(df.schema[c].dataType)

    rows = prepare(df, cont_null, cat_null)
    if strategy == "baseline":
        rows = cut(rows)
        train = lambda r: r.where(F.col("null_cnt") < k) if k > 1 else r
        for round_ in range(iterations):
            models = []
            for c in targets:
                value = stat(train(rows).where(~F.col(flag(c))))
                if on_train:
                    on_train(c, value, rows)
                models.append((c, model_column(c, value, f"{c}/{round_}")))
                here = F.col("null_cnt") < k if k > 1 else F.lit(True)
                rows = cut(rows.withColumn(c, F.when(F.col(flag(c)) & here, models[-1][1]).otherwise(F.col(c))), rows)
            if k > 1:
                last = F.col("null_cnt") == k
                new = rows
                for c, predicted in models:
                    new = new.withColumn(c, F.when(last, predicted).otherwise(F.col(c)))
                rows = cut(new, rows)
        return rows.select(*names)

    place = F.when(F.col("null_cnt") == 0, "none").when((F.col("null_cnt") == k) & (F.lit(k) > 1), "all").when(F.col("null_cnt") == 1, F.concat(F.lit("one"), F.col("null_col_id").cast("string"))).otherwise("some")
    parts = Parts(rows.withColumn("null_part", place), "null_part")
    single = {c: f"one{i}" for i, c in enumerate([*cont_null, *cat_null], 1)}
    trained = ["none", *single.values(), "some"]
    whole = stat(parts.read("none")) if strategy == "reverse" else stat(parts.read(*trained))
    for round_ in range(iterations):
        models = []
        for c in targets:
            missing = F.col(flag(c))
            touched = lambda c=c, missing=missing: parts.read(single[c], "some").where(missing)
            value = whole + stat(parts.read(*trained[1:]).where(~missing)) if strategy == "reverse" else whole - stat(touched())
            if on_train:
                on_train(c, value, parts.read(*parts.names))
            models.append((c, model_column(c, value, f"{c}/{round_}")))
            for name in (single[c], "some"):
                parts.rewrite(name, lambda r: imputed(r, models[-1:]))
            if strategy != "reverse":
                whole = value + stat(touched())
        parts.rewrite("all", lambda r: imputed(r, models))
    return parts.read(*parts.names).select(*names)


def impute_dimension(fact: DataFrame, dim: DataFrame, key: str, column: str, prediction: Column) -> DataFrame:
    """Nulls of a dimension's column become the mean, by key, of predictions over the joined rows, kept in a side table and coalesced."""
    side = fact.join(dim, key).where(F.col(column).isNull()).groupBy(key).agg(F.avg(prediction).alias("_side"))
    return dim.join(side, key, "left").withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("_side"))).drop("_side")
