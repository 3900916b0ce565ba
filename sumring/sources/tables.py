"""Reading and writing tables, and the text form of ring values."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.cofactor import Cofactor


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header-less CSV, the empty string as null."""
    return spark.read.schema(schema).csv(path, nullValue="", emptyValue="")


def read_pipe(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Pipe-delimited text."""
    return spark.read.schema(schema).csv(path, sep="|")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_partitioned(df: DataFrame, path: str, bucket: Column) -> None:
    """A table by null pattern, so that scans of one pattern prune to its folder."""
    df.withColumn("null_bucket", bucket).write.mode("overwrite").partitionBy("null_bucket").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, nullValue="")


def ring_to_text(value: Column) -> Column:
    """Lossless text of a ring struct."""
    return F.to_json(value)


def ring_from_text(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def cofactor_to_text(v: Cofactor) -> str:
    """Lossless JSON of a driver-side value."""
    pairs = lambda m: [[list(k) if isinstance(k, tuple) else k, x] for k, x in m.items()]
    maps = lambda g: [[k if isinstance(k, str) else list(k), pairs(m)] for k, m in g.items()]
    return json.dumps({"cont": v.cont, "cat": v.cat, "n": v.n, "lin": v.lin.tolist(), "quad": v.quad.tolist(), "lin_cat": maps(v.lin_cat), "num_cat": maps(v.num_cat), "cat_cat": maps(v.cat_cat)})


def cofactor_from_text(text: str) -> Cofactor:
    d = json.loads(text)
    key = lambda k: tuple(k) if isinstance(k, list) else k
    maps = lambda g: {key(k): {key(a): x for a, x in m} for k, m in g}
    return Cofactor(d["cont"], d["cat"], d["n"], d["lin"], d["quad"], maps(d["lin_cat"]), maps(d["num_cat"]), maps(d["cat_cat"]))
