"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its ``NEAREST`` reference points in order of closeness. The inverted list of a pivot holds the vectors that have it
in their description. Within a list, candidates are the pairs that share at least ``SHARED`` pivots; their cosines are computed in double
precision. A pair counts in one list only, that of its least shared pivot, so a vector is sent to the lists of all its pivots but the
``SHARED`` - 1 largest. Tasks return link counts and local classes, never pairs, so a large group of copies costs arithmetic but no rows.

Equal vectors are one node with a multiplicity. Lists over ``BLOCK`` vectors are cut into blocks that meet pairwise; a vector of such a list
is sent once for each block, as every vector's links are to be counted. The number of pivots grows with the square root of the vectors up to
``MAX_PIVOTS`` (a thousand million vectors); they are a bounded sample of distinct vectors by hash. Every vector is indexed. Recall is
measured against brute force in the tests.

Edges: null, zero and non-finite vectors, null labels and null ids link with nothing; vectors of different lengths never link; repeated rows
are vectors of their own; of pivots equally close the first counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, small_batches

COSINE = 0.98
#: Reference points of a description, of which two near vectors share so many; pivots at least and at most (8 bytes a number, broadcast).
NEAREST, SHARED, MIN_PIVOTS, MAX_PIVOTS = 4, 2, 16, 16_384
#: Vectors of a block, pairs that are compared at once.
BLOCK, TILE = 8192, 1 << 21
#: List sizes (32 bytes each) up to which they are broadcast.
BROADCAST_LISTS = 500_000


def _usable(v: str) -> F.Column:
    return F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _unit(rows) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in rows])
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow or underflow in the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _own(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Whether rows of two arrays of descriptions share ``SHARED`` pivots, the least of them p."""
    shared = np.sort(np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int32).max), 1)
    return (shared[:, 0] == p) & (shared[:, SHARED - 1] < np.iinfo(np.int32).max)


def verify_list(ids: np.ndarray, mult: np.ndarray, v: np.ndarray, near: np.ndarray, side: np.ndarray, p: int, threshold: float):
    """Links of the list of pivot p, or of two blocks of one (``side`` 0 and 1; only pairs across then): (ids with links, their counts, their
    least local id). Memory is bounded by the list and ``TILE`` pairs."""
    order = np.argsort(ids, kind="stable")
    ids, mult, v, near, side = ids[order], mult[order], v[order], near[order], side[order]
    counts, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
    across = side.any()
    rows, cols = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(len(ids)),) * 2
    step = max(1, TILE // max(1, len(cols)))
    for a in range(0, len(rows), step):
        i, j = np.nonzero(v[rows[a : a + step]] @ v[cols].T >= threshold)
        i, j = rows[a + i], cols[j]
        if not across:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 200_000):
            x, y = i[c : c + 200_000], j[c : c + 200_000]
            own = _own(near[x], near[y], p)
            x, y = x[own], y[own]
            counts += np.bincount(x, mult[y], len(ids)).astype(np.int64) + np.bincount(y, mult[x], len(ids)).astype(np.int64)
            while len(x):  # join classes at their least members, until every pair is inside one
                x, y = parent[x], parent[y]
                x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
                np.minimum.at(parent, y, x)
                while (parent != (up := parent[parent])).any():
                    parent = up
    keep = counts > 0
    return ids[keep], counts[keep], ids[parent[keep]]


def _verify_sorted(it, threshold: float):
    """Cells come one after another, sorted; each is held until the next begins."""

    def verified(parts: list[pd.DataFrame]) -> pd.DataFrame:
        cell = pd.concat(parts, ignore_index=True)
        got = verify_list(cell["rep"].to_numpy(), cell["mult"].to_numpy(), _unit(cell["v"]), np.array(cell["near"].tolist(), np.int32), cell["side"].to_numpy(), int(cell["p"].iloc[0]), threshold) if len(cell) > 1 else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("rep", "links", "low"), got, strict=True)))

    held: list[pd.DataFrame] = []
    now = None
    for pdf in it:
        if not len(pdf):
            continue
        keys = list(pdf[CELL].itertuples(index=False, name=None))
        at = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if held and keys[a] != now:
                yield verified(held)
                held = []
            now = keys[a]
            held.append(pdf.iloc[a:b])
    if held:
        yield verified(held)


CELL = ["label", "dim", "p", "b0", "b1"]


def near_duplicates(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label). Vectors link only within a non-null label; rows
    that repeat a vec_id with the same vector are other vectors of the same id."""
    small_batches(vectors.sparkSession)
    wide = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"), wide.alias("v"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable("v")
    # A vector is known by two hashes of label and numbers, so that whole vectors need not be shuffled to find equal ones again.
    h1, h2 = (F.when(usable, F.xxhash64(F.lit(k), "label", "v")).alias(f"h{k}") for k in (1, 2))
    known = rows.select("vec_id", "label", "embedding", h1, h2)
    good = known.where("h1 is not null")
    nodes = materialize(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("v")), "pnodes")
    n = nodes.count()
    m = int(min(MAX_PIVOTS, max(MIN_PIVOTS, round(n**0.5 / 2))))
    sample = nodes.orderBy("h1", "rep").limit(m).select("v").collect() if n else []
    pivots: dict[int, np.ndarray] = {}
    for size in {len(r["v"]) for r in sample}:
        pivots[size] = _unit([r["v"] for r in sample if len(r["v"]) == size])
    bc = vectors.sparkSession.sparkContext.broadcast(pivots)

    def describe(it):
        for pdf in it:
            frame = pdf.assign(dim=pdf["v"].map(len).astype(np.int32))
            for dim, part in frame.groupby("dim"):
                ref = bc.value.get(dim)
                if ref is None or len(ref) < SHARED:
                    near = np.tile(np.arange(SHARED, dtype=np.int32), (len(part), 1))  # too few pivots of this length: one list
                else:
                    near = np.argsort(-(_unit(part["v"]) @ ref.T), 1, kind="stable")[:, : min(NEAREST, len(ref))].astype(np.int32)
                yield part.assign(near=list(near))

    described = nodes.select("label", "v", "rep", "mult").mapInPandas(describe, f"label string, v {nodes.schema['v'].dataType.simpleString()}, rep long, mult long, dim int, near array<int>")
    lists = described.withColumn("p", F.explode(F.slice(F.array_sort("near"), F.lit(1), F.size("near") - (SHARED - 1))))
    key = ["label", "dim", "p"]
    size = lists.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key, F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    size = materialize(size, "psizes")  # a row for each label and pivot at most
    cells = lists.join(F.broadcast(size) if size.count() <= BROADCAST_LISTS else size, key).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A block meets itself and every other one: rows go to the cells (min, max) of their block with each block.
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumns({"b0": F.least("blk", "other"), "b1": F.greatest("blk", "other")})
    cells = cells.withColumn("side", F.when(F.col("b0") == F.col("b1"), 0).otherwise((F.col("blk") == F.col("b1")).cast("int")))
    cells = cells.select(*CELL, "rep", "mult", "v", "near", "side").repartition(*CELL).sortWithinPartitions(*CELL)
    found = cells.mapInPandas(lambda it: _verify_sorted(it, threshold), "rep long, links long, low long")
    found = materialize(found, "plinks")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")), "pcomp")
    node = nodes.select("h1", "h2", "rep", "mult").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    node = node.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("comp"))
    # Back to rows by the hashes; rows outside the index stay alone.
    out = known.select("vec_id", "h1", "h2").join(node, ["h1", "h2"], "left")
    comp_id = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(comp_id == F.col("vec_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
