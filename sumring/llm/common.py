"""Shared helpers of the text-corpus operators: shared storage, written intermediates, connected components.

Every intermediate that cuts lineage is a Parquet table in the folder the cluster names in ``spark.checkpoint.dir``;
a lost executor costs its running tasks only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_own: dict[str, str] = {}
_kept: dict = {}


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches to Python workers hold at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``, as rows here are whole texts. A smaller
    setting of the session stays."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def beside(docs: DataFrame, names: list[str], text: str, fields: list, make) -> DataFrame:
    """Columns ``names`` of ``docs``, untouched, and new ones (``fields``) that ``make(texts)`` gives as lists, batch by batch. Batches stay
    Arrow columns, so that ids beyond 2**53 and nulls of any type pass exactly."""
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    new = {f.name for f in fields}
    names = [c for c in names if c not in new]
    hidden = unused(docs, "text")

    def run(it):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in it:
            more = make(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(x, k) for x, k in zip(more, kinds, strict=True))], names=[*names, *(f.name for f in fields)])

    src = docs.select(*(F.col(quoted(c)) for c in names), F.col(quoted(text)).alias(hidden))
    return src.mapInArrow(run, StructType([*(docs.schema[c] for c in names), *fields]))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it unlike any column of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    name = "_" + name
    while name.lower() in taken:
        name = "_" + name
    return name


def worker_tables(owner=None, make=None):
    """What ``owner`` keeps in a Python worker between tasks (made on first use). What other owners kept there is freed, so that a worker,
    which outlives stages, holds one operator's tables at a time. Without an owner all is freed."""
    if owner not in _kept:
        _kept.clear()
        if owner is not None:
            _kept[owner] = make()
    return _kept.get(owner)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set (tests on one machine) a temporary folder is made once."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/") + "/sumring"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="sumring-"))


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. ``stored_at`` of the result names the folder."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "stored_at", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside a row expression, so that a lambda below does not evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % m


#: A node of more edges than this is a hub ...
HUB = 256
#: ... or of more than so much of all edges, so that there are at most so many hubs (16 bytes each), which are broadcast.
MOST_HUBS = 500_000


def _with_least(edges: DataFrame, of: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (a, b) with ``m``, the least of node ``a`` in ``of`` (a, m, k edges). Edges of hubs are not shuffled; where all nodes are no
    more than hubs may be, no edges are."""
    if 2 * n_edges <= MOST_HUBS:
        return edges.join(F.broadcast(of.select("a", "m")), "a")
    hub = max(HUB, 2 * n_edges // MOST_HUBS)
    hubs = F.broadcast(of.where(F.col("k") > hub).select("a", "m"))
    few = edges.join(F.broadcast(of.where(F.col("k") > hub).select("a")), "a", "left_anti")
    return edges.join(hubs, "a").unionByName(few.join(of.where(F.col("k") <= hub).select("a", "m"), "a"))


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b), by alternating large and small
    stars; each round is written to the shared folder. Rounds grow with the logarithm of the longest chain.

    Self loops and repeated edges are allowed; no edges give an empty table.
    """
    tidy = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = materialize(tidy(edges.select("a", "b")), label)
    before = None
    while True:
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("k"))
        large = _with_least(both.where("b > a"), least, mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        small = _with_least(large, low, mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = materialize(tidy(small), label)
        discard(cur)
        cur = after
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
