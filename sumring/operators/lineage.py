"""Cutting the lineage of iterative pipelines through tables in the cluster's shared folder, and tables kept in parts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh name in the folder of ``spark.checkpoint.dir`` (a temporary one only where none is set on a local master)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="sumring-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Write and read again; ``stored_at`` of the result names the folder. That of ``before``, an earlier result that nothing needs any more, is
    removed."""
    spark = df.sparkSession
    path = shared_path(spark, "impute")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if before is not None and getattr(before, "stored_at", None):
        remove(spark, before.stored_at)
    return out


class Parts:
    """A table in parts by the text column ``by``, each of which can be read and rewritten alone."""

    def __init__(self, df: DataFrame, by: str):
        self.spark, self.schema, self.by = df.sparkSession, df.drop(by).schema, by
        self.root = shared_path(self.spark, "parts")
        df.write.partitionBy(by).parquet(self.root)
        whole = self.spark.read.schema(df.select(*(c for c in df.columns if c != by), by).schema).parquet(self.root)
        self.names = sorted(r[0] for r in whole.select(by).distinct().collect())
        self.part = {n: whole.where(F.col(by) == n).drop(by) for n in self.names}  # pruned to the part's folder
        self.folder = {n: f"{self.root}/{by}={n}" for n in self.names}

    def read(self, *names: str) -> DataFrame:
        """Rows of the named parts that there are."""
        out = None
        for n in names:
            if n in self.part:
                out = self.part[n] if out is None else out.unionByName(self.part[n])
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def rewrite(self, name: str, change) -> None:
        """Replace one part by ``change`` of it; its old folder goes."""
        if name in self.part:
            new = cut(change(self.part[name]))
            self.drop(name)
            self.part[name], self.folder[name] = new, new.stored_at

    def drop(self, name: str) -> None:
        """Remove a part."""
        remove(self.spark, self.folder.pop(name))
        del self.part[name]
