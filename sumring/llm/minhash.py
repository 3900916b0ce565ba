"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once; the top byte names a bin, the least hash of a bin is its value. Empty bins borrow by optimal
densification: bin i probes bins h(i, 1), h(i, 2), ... until one is filled; after ``PROBES`` probes the filled bin of least h(i, bin)
is taken, which is a further uniform choice that depends on the filled bins alone. The low ``BITS`` bits of each value are packed,
as a hexadecimal digit. Likeness of two fingerprints: share of equal digits, corrected for chance (2**-BITS), within 0 to 1.

Scale: everything is inside one row; documents are shuffled once, into ranges of doc_id, only to pair each with the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, words_of

SHINGLE, BINS, BITS, PROBES = 5, 256, 4, 12
#: Ranges of doc_id that are cut at once.
FANOUT = 512
#: Characters of text that a range should hold.
RANGE_CHARS = 8_000_000
_LOW = (1 << 56) - 1  # what follows the top byte; all ones marks an empty bin


def _shingles(text: Column) -> Column:
    """Hashes of the shingles; with fewer words, of the whole sequence; none without words."""
    hashes = F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w))

    def body(h):
        at = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE)))
        many = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), at)
        few = F.transform(F.array(h), lambda x: F.xxhash64(x, F.lit("short")))
        return F.when(F.size(h) >= SHINGLE, many).when(F.size(h) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, body)


def _bins(text: Column) -> Column:
    """The least hash of each of the bins in order; bins without any hold the sentinel of all low bits."""
    marks = F.transform(F.sequence(F.lit(-128), F.lit(127)), lambda b: F.shiftleft(b.cast("long"), 56).bitwiseOR(F.lit(_LOW)))
    every = F.sort_array(F.concat(_shingles(text), marks))
    top = lambda x: F.shiftright(x, 56)
    return let(every, lambda a: F.filter(a, lambda x, i: (i == 0) | (top(x) != top(F.get(a, i - 1)))))


def signature(text: Column) -> Column:
    """Array of ``BINS`` numbers of ``BITS`` bits; null entries throughout for a text without words."""
    low = lambda x: x.bitwiseAND(F.lit(_LOW))

    def densify(v):  # v: low part of each bin, null where empty
        def filled(x, i):
            probes = [F.get(v, F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")) for a in range(PROBES)]
            full = F.filter(F.transform(v, lambda y, j: F.when(y.isNotNull(), F.struct(F.xxhash64(i, j, F.lit("last")).alias("o"), y.alias("y")))), lambda s: s.isNotNull())
            return F.coalesce(x, *probes, F.array_min(full)["y"])

        return F.transform(v, filled)

    def whole(b):
        v = F.transform(b, lambda x: F.when(low(x) != F.lit(_LOW), low(x)))
        return let(v, lambda n: F.when(F.exists(n, lambda x: x.isNotNull()), densify(n)).otherwise(n))

    # Hashed with its bin before it is cut to BITS, so that bins which borrowed one value do not collide together.
    return F.transform(let(_bins(text), whole), lambda x, i: F.when(x.isNotNull(), F.xxhash64(x, i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("tinyint")))


def to_hex(sig: Column) -> Column:
    """Packed fingerprint, a digit per bin; the empty string for a text without words."""
    digits = F.array(*(F.lit(f"{i:x}") for i in range(16)))
    return F.when(F.get(sig, 0).isNull(), F.lit("")).otherwise(F.array_join(F.transform(sig, lambda x: F.get(digits, x.cast("int"))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures. Two texts without words are alike (1), one without words is unlike any other (0)."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    none = lambda s: F.get(s, 0).isNull()
    j = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(none(a) & none(b), F.lit(1.0)).when(none(a) | none(b), F.lit(0.0)).otherwise(j)


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def _bucket(cuts: Column) -> Column:
    """How many of the sorted ``cuts`` are below doc_id; nulls come first."""
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))))


def with_ranges(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with ``range``, ascending in doc_id: about ``k`` ranges of as many rows each, by approximate quantiles; beyond ``FANOUT`` each
    range is cut into ranges of its own once more (a table of at most ``FANOUT`` rows, which is broadcast)."""
    steps = lambda n: [i / n for i in range(1, n)]
    top = min(k, FANOUT)
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", steps(top), 10_000)).first()[0] or [])) if top > 1 else []
    rows = docs.withColumn("range", (_bucket(F.array(*map(F.lit, cuts))) if cuts else F.lit(0)).cast("long"))
    if k <= FANOUT:
        return rows
    below = min(FANOUT, -(-k // FANOUT))
    fine = rows.groupBy("range").agg(F.array_sort(F.array_distinct(F.percentile_approx("doc_id", steps(below), 10_000))).alias("cuts")) if below > 1 else rows.select("range", F.array().cast("array<long>").alias("cuts")).distinct()
    return rows.join(F.broadcast(fine), "range").withColumn("range", F.col("range") * FANOUT + _bucket(F.coalesce("cuts", F.array().cast("array<long>")))).drop("cuts")


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """``docs`` (doc_id, text) in ranges of ascending doc_id (nulls first, ties by text), each range followed by a copy (``extra``) of the
    first row of the next one, the last by the first of all. Only the numbers of the ranges go through the driver."""
    n, chars = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    rows = with_ranges(docs, int(max(1, min((chars or 0) // RANGE_CHARS + 1, n))))
    there = sorted(r[0] for r in rows.select("range").distinct().collect())  # at most FANOUT**2 numbers
    place = docs.sparkSession.createDataFrame([(r, there[i - 1]) for i, r in enumerate(there)], "range long, before long")
    # The first row of each range, by (doc_id, text) with nulls first, as min over a struct.
    first = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "text")).alias("f")).join(F.broadcast(place), "range")
    extra = first.select(F.col("f.doc_id").alias("doc_id"), F.col("f.text").alias("text"), F.col("before").alias("range"), F.lit(True).alias("extra"))
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    w = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    return both, w


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; null text as empty; repeated rows each count): n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The last document is followed by the first; a single one by itself."""
    both, w = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = both.withColumn("following", F.lead("text").over(w))
    rows = rows.withColumn("sig", signature(F.col("text")))
    rows = rows.withColumn("next_sig", F.lead("sig").over(w)).where(~F.col("extra"))
    rows = rows.withColumn("changed", edited(F.col("text"), F.col("following")))
    rows = rows.withColumn("edited_sig", signature(F.col("changed")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("changed", "UTF-8"), 256).alias("edited_sha256"), to_hex(F.col("sig")).alias("fingerprint"),
        to_hex(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
