"""Feature preparation, simulated missingness, quality measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of a calendar number on its circle."""
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def date_features(df: DataFrame, ts: str) -> DataFrame:
    """Cyclic month, day of month and weekday (0 is Monday)."""
    parts = {"month": (F.month(ts), 12), "day": (F.dayofmonth(ts), 31), "weekday": (F.weekday(ts), 7)}
    return df.withColumns({f"{k}_{n}": v for k, (c, p) in parts.items() for n, v in zip(("sin", "cos"), cyclic(c, p), strict=True)})


def hour_minute(df: DataFrame, column: str) -> DataFrame:
    """A clock time written as hhmm, split into hour and minute."""
    return df.withColumns({f"{column}_hour": F.floor(F.col(column) / 100), f"{column}_min": F.col(column) % 100})


def overnight(departure: Column, arrival: Column) -> Column:
    return (arrival < departure).cast("int")


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0. One aggregation, then a projection."""
    r = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return df.withColumns({c: (F.col(c) - F.lit(r[f"m_{c}"])) / F.lit(r[f"s_{c}"] or 1.0) for c in columns})


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Codes 0, 1, ... in sorted order of the distinct values, by a dictionary join; null has no code. The dictionary alone is numbered in one
    task, so this is for columns of categories, not of keys."""
    dictionary = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(out, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(dictionary, column, "left")


def price_feature(price: Column) -> Column:
    p = F.log(F.abs(F.log(F.abs(price) + 0.01)) + 0.01)
    return F.cos(p) + p


def hash_unit(keys: list[Column]) -> Column:
    """A number in [0, 1) from an md5 of the keys, equal in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mcar(column: str, keys: list[Column], ratio: float) -> Column:
    """The column with nulls completely at random."""
    return F.when(hash_unit(keys) >= ratio, F.col(column))


def mask_by_rank(df: DataFrame, column: str, driver: str, keys: list[Column], ratio: float) -> DataFrame:
    """MAR (driver is another column) or MNAR (driver is the column): a row loses its value with a chance that grows in proportion to the rank
    of the driver, ``ratio`` on the whole. Ranks come from grouped counts of the driver's values, so no window holds all rows; equal
    values share their mean rank; rows without a driver lose nothing."""
    n = df.where(F.col(driver).isNotNull()).count()
    counts = df.where(F.col(driver).isNotNull()).groupBy(F.col(driver).alias("_driver")).agg(F.count("*").alias("_k"))
    # Running counts in two steps: of ranges of values (few), then within a range.
    ranges = counts.withColumn("_range", F.width_bucket("_driver", *(F.lit(x) for x in _limits(df, driver)), F.lit(RANGES)))
    before = ranges.groupBy("_range").agg(F.sum("_k").alias("_all")).withColumn("_before", F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).drop("_all")
    inside = F.sum("_k").over(Window.partitionBy("_range").orderBy("_driver"))
    rank = ranges.withColumn("_upto", inside).join(F.broadcast(before), "_range").select("_driver", ((F.col("_before") + F.col("_upto") - (F.col("_k") - 1) / 2) / F.lit(float(n + 1))).alias("_rank"))
    out = df.join(rank, df[driver] == rank["_driver"], "left")
    return out.withColumn(column, F.when(F.coalesce(hash_unit(keys) >= 2 * ratio * F.col("_rank"), F.lit(True)), F.col(column))).drop("_driver", "_rank")


#: Ranges of a driver's values that are ranked apart.
RANGES = 1000


def _limits(df: DataFrame, driver: str) -> tuple[float, float]:
    low, high = df.agg(F.min(driver), F.max(driver)).first()
    low = float(low or 0)
    return low, max(float(high or 0), low) + 1.0


def mean_interval(values: Column, critical: float) -> tuple[Column, Column]:
    """Ends of the confidence interval of a mean, aggregates; ``critical`` is the quantile of Student's t for the size of the sample."""
    half = critical * F.stddev_samp(values) / F.sqrt(F.count(values))
    return F.avg(values) - half, F.avg(values) + half


def rmse(truth: Column, guess: Column) -> Column:
    """Root mean square error, an aggregate."""
    return F.sqrt(F.avg((truth - guess) * (truth - guess)))


def r_squared(truth: Column, guess: Column) -> Column:
    return 1 - F.sum((truth - guess) * (truth - guess)) / (F.var_pop(truth) * F.count(truth))
