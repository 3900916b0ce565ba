"""N-gram Jaccard self-join: documents whose sets of word shingles overlap by a share or more (op7: 3 words, 90 %), as linked classes.

Shingles are hashed into groups. Two uses of the same idea:

1. Routing. Sets A, B with Jaccard >= t differ in at most d = (|A| + |B|) (1 - t) / (1 + t) shingles, so of d + 1 groups at least one
   holds the very same shingles in both. Each document sends one key per group (a hash of the group's content, by size class);
   linked documents share a key. All documents of a key are in the star of the key's least document.
2. Count-vector R-tree. Each set is a point, its counts by groups. The overlap of two sets is at most the sum of the coordinate-wise
   minima of their points; of a point and a tree node, of the point and the node's upper corner. Within a star (points of ``POINT``
   groups, of more for long texts, as full groups tell nothing apart) the tree finds which documents may link; components of these pairs are the candidate clusters, so that documents which only
   share a passage are not chained together. A star of over ``STAR`` documents is one candidate as a whole. Within a cluster (points of
   ``GROUPS`` groups) the tree prunes again, and the rest is verified on the sets. Pairs already in one class are skipped.

Clusters of over ``BLOCK`` shingles are cut into blocks: one block of leaders meets all blocks; then only documents outside the cluster's
largest class, in blocks of their own, meet all blocks. Every pair is thereby tested or known to be connected; no task holds more
than two blocks (and no block is larger unless by one document).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, small_batches, worker_tables
from .wordhash import blocks, mix, shingle_hashes, word_hashes

#: Link if NUM/DEN of the union is shared, of sets of SHINGLE words; what op7 asks for.
NUM, DEN = 90, 100
SHINGLE = 3
#: Coordinates of the points, tree fan-out, shingles (8 bytes each) of a block.
GROUPS, FANOUT, BLOCK = 64, 16, 1 << 20
#: Least and most coordinates of the points in stars, shingles for which a group is added between them; beyond the most, bounds are looser
#: and nothing is lost.
POINT, WIDEST, DENSE = 256, 4096, 8
#: Documents of a star up to which its tree is searched, coordinates bounded at a time.
STAR, _CELLS = 2048, 1 << 20
#: Size classes grow by this factor; one spare group for so many.
CLASS, SPARE = 1.25, 3
#: Ids (8 bytes each) of candidates, of copies and of dropped documents up to which they are broadcast; beyond it joins shuffle.
BROADCAST_IDS = 2_000_000
#: Parts into which the rows of one set are dealt where equal sets are matched.
SALTS = 256
_BATCH = 1 << 18


def shingle_set(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(words, k))


def size_classes(n: int, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """(class, groups) in which a set of ``n`` shingles sends keys: its own class, and the next if a linked set may be there."""
    out = []
    c = int(np.floor(np.log(n) / np.log(CLASS) + 1e-9))
    for cls in (c, c + 1):
        low, high = int(np.ceil(CLASS**cls - 1e-6)), int(np.ceil(CLASS ** (cls + 1) - 1e-6)) - 1
        if cls == c or n * den >= low * num:
            # Both sets have at most ``high`` shingles (or this one is just below the class).
            out.append((cls, 2 * max(high, n) * (den - num) // (den + num) + 1))
    return out


def keys_of(shingles: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Routing keys of a set. With ``spare`` groups more than differences plus one, linked sets agree in ``spare`` + 1 groups at least. So a
    set may leave out all its groups of up to s shingles, where s is the largest size of which it has ``spare`` groups at most: linked
    sets still agree in a group that is above both their s. This drops the keys that say least (empty groups first)."""
    out = []
    for cls, least in size_classes(len(shingles), num, den):
        spare = least // SPARE
        groups = least + spare
        g = (mix(shingles + np.uint64(977 * cls + 11)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(g, kind="stable")
        sums = np.cumsum(np.concatenate([[np.uint64(0)], mix(shingles[order] ^ np.uint64(0x5851F42D4C957F2D))]), dtype=np.uint64)
        at = np.searchsorted(g[order], np.arange(groups + 1))
        content, size = sums[at[1:]] - sums[at[:-1]], np.diff(at)
        tag = np.arange(groups, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(cls * 7919 + 1)
        by_size = np.cumsum(np.bincount(size))
        small = np.searchsorted(by_size, spare, side="right") - 1
        out.append(mix(mix(content + np.uint64(1)) ^ mix(tag))[size > small])
    return np.concatenate(out)


def _per_text(docs: DataFrame, row, fields: str) -> DataFrame:
    """doc_id and ``fields``, which ``row`` makes of the hashes of each text's words."""

    def run(it):
        worker_tables()
        for pdf in it:
            ids, texts = pdf["doc_id"].to_numpy(), [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            for a, b in blocks(texts, _BATCH):
                hashes, counts = word_hashes(texts[a:b])
                split = np.split(hashes, np.cumsum(counts)[:-1])
                yield pd.DataFrame([(i, *row(h)) for i, h in zip(ids[a:b], split, strict=True)], columns=cols)

    cols = ["doc_id", *(f.split()[0] for f in fields.split(", "))]
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # exact in pandas, nulls included
    return ids.mapInPandas(run, f"doc_id string, {fields}").withColumn("doc_id", F.col("doc_id").cast("long"))


def _points(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size n and point of the set, and a digest of it (d1, d2)."""

    def row(words: np.ndarray):
        s = shingle_set(words, k)
        m = mix(s + np.uint64(3))
        return len(s), count_vector(s, coordinates(len(s))).astype("<u4").tobytes(), int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(m).view(np.int64)) if len(s) else 0

    return _per_text(docs, row, "n long, point binary, d1 long, d2 long")


def _keys(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, key: one row for each routing key. They are made anew from the texts, as they would take more room than these."""

    def row(words: np.ndarray):
        s = shingle_set(words, k)
        return (keys_of(s, num, den).view(np.int64) if len(s) else None,)

    return _per_text(docs, row, "keys array<long>").select("doc_id", F.explode("keys").alias("key"))


class Tree:
    """R-tree over count vectors, packed bottom-up in order of size, then of the widest coordinates; nodes keep upper corners and the
    range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        wide = np.argsort(-points.var(0), kind="stable")[:2] if len(points) else [0, 0]
        self.order = np.lexsort([points[:, wide[1]], points[:, wide[0]], sizes])
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = []
        while True:
            n = -(-len(top) // FANOUT)
            cut = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))
            if n <= FANOUT:
                break

    def search(self, point: np.ndarray, size: int, num: int = NUM, den: int = DEN) -> np.ndarray:
        """Indices whose overlap with ``point`` may reach num / den of the union."""
        return self.pairs(point[None], np.array([size]), num, den)[1]

    def pairs(self, points: np.ndarray, sizes: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): the overlap of ``points[i]`` with the tree's point j may reach num / den of the union."""
        top = len(self.levels[-1][0])
        query, nodes = np.repeat(np.arange(len(points)), top), np.tile(np.arange(top), len(points))
        for depth in range(len(self.levels) - 1, -2, -1):
            if depth >= 0:
                corner, low, high = self.levels[depth]
                at = nodes
            else:
                corner, low, high = self.points, self.sizes, self.sizes
                at = self.order[nodes]
            size = sizes[query]
            ok = (low[at] * num <= size * den) & (high[at] * den >= size * num)
            query, nodes, at, size = query[ok], nodes[ok], at[ok], size[ok]
            step = max(1, _CELLS // points.shape[1])
            bound = [np.minimum(corner[at[a : a + step]], points[query[a : a + step]]).sum(1) for a in range(0, len(at), step)]
            # overlap >= num / den * (size + other - overlap), for the least other size of the node
            ok = np.concatenate([*bound, np.zeros(0, np.int64)]) * (den + num) >= num * (size + low[at])
            query, nodes = query[ok], nodes[ok]
            if depth >= 0:
                count = len(self.levels[depth - 1][0]) if depth else len(self.order)
                query, nodes = np.repeat(query, FANOUT), (nodes[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
                query, nodes = query[nodes < count], nodes[nodes < count]
        return query, self.order[nodes]


def count_vector(items: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((items.view(np.uint64) % np.uint64(groups)).astype(np.int64), minlength=groups)


def coordinates(n: int) -> int:
    """Coordinates of the point of ``n`` shingles in stars: ``POINT``, doubled up to ``WIDEST`` while groups hold over ``DENSE`` on average."""
    width = POINT
    while width < WIDEST and n > DENSE * width:
        width *= 2
    return width


def folded(points: list[bytes]) -> np.ndarray:
    """Points of the fewest coordinates among ``points``: of two widths the larger is a multiple, so that its groups add up to the smaller's."""
    width = min(map(len, points)) // 4
    return np.array([np.frombuffer(p, "<u4").reshape(-1, width).sum(0) for p in points], np.int32)


def linked(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> bool:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return den * inter >= num * (len(a) + len(b) - inter) and inter > 0


def join_block(ids: np.ndarray, items: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Least id of each document's class within the block, testing every pair of ``left`` with ``right`` unless it is connected."""
    parent = list(range(len(ids)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    points, sizes = np.array([count_vector(x) for x in items]), np.array([len(x) for x in items])
    at = np.flatnonzero(right)
    tree = Tree(points[at], sizes[at])
    for i in np.flatnonzero(left):
        for j in at[tree.search(points[i], sizes[i], num, den)]:
            if i != j and (a := find(i)) != (b := find(j)) and linked(items[i], items[j], num, den):
                parent[a] = b
    roots = np.array([find(i) for i in range(len(ids))])
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, ids)
    return least[roots]


def star_classes(points: np.ndarray, sizes: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Classes (least index) of sets that may link, by the bound on their points: all that may link with the first one, then what the tree
    finds for the others."""
    bound = np.minimum(points, points[0]).sum(1)
    may = (bound * (den + num) >= num * (sizes + sizes[0])) & (sizes * den >= sizes[0] * num) & (sizes[0] * den >= sizes * num)
    may[0] = True
    label = np.where(may, 0, np.arange(len(sizes)))
    rest = np.flatnonzero(~may)
    if len(rest):
        i, j = Tree(points, sizes).pairs(points[rest], sizes[rest], num, den)
        i = rest[i]
        while True:
            before = label.copy()
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            label = label[label]
            if (label == before).all():
                break
    return label


def _candidates(near: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between documents of one star of ``near`` (doc_id a, least doc_id b of a key) that may link by their points. A star holds
    all documents of its keys, so nothing that links is lost. Stars of over ``STAR`` documents keep their edges as they are."""
    large = near.groupBy("b").count().where(F.col("count") > STAR).select("b")
    large = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    small = near.join(large, "b", "left_anti").select(F.col("b").alias("least"), F.col("a").alias("doc_id"))
    star = small.unionByName(small.select("least", F.col("least").alias("doc_id")).distinct())
    points = known.select("doc_id", "n", "point", "d1", "d2").repartition("doc_id").dropDuplicates(["doc_id", "n", "d1", "d2"])
    parts = near.count() // STAR + 1  # so that a part holds about STAR points, and one star more at most
    rows = star.join(points, "doc_id").select("least", "doc_id", "n", "point", F.pmod(F.xxhash64("least"), F.lit(parts)).alias("part"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["least", "doc_id"], kind="stable")
        star, ids, sizes = pdf["least"].to_numpy(), pdf["doc_id"].to_numpy(), pdf["n"].to_numpy()
        points = pdf["point"].tolist()
        at = np.flatnonzero(np.r_[True, star[1:] != star[:-1], True])
        first = np.concatenate([ids[a + star_classes(folded(points[a:b]), sizes[a:b], num, den)] for a, b in zip(at[:-1], at[1:], strict=True)])
        return pd.DataFrame({"a": ids[first != ids], "b": first[first != ids]})

    return rows.groupBy("part").applyInPandas(run, "a long, b long").unionByName(near.join(large, "b", "left_semi").select("a", "b"))


def _with_text(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (doc_id, cluster, ...) with their texts, which compress better than their sets; a repeated doc_id comes once per row of
    ``docs``."""
    few = members.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(members) if few else members, "doc_id")


def _meet(cells: DataFrame, label: str, k: int, num: int, den: int) -> DataFrame:
    """(a, b) class edges. Rows (cluster, lead, blk, doc_id, left, right, text) of one (cluster, lead, blk) meet in a task: those marked
    left with those marked right."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids = pdf["doc_id"].to_numpy()
        new = np.r_[True, ids[1:] != ids[:-1]]
        at = np.cumsum(new) - 1
        left, right = np.zeros(at[-1] + 1, bool), np.zeros(at[-1] + 1, bool)
        left[at[pdf["left"].to_numpy()]] = True
        right[at[pdf["right"].to_numpy()]] = True
        texts = [(t or "").encode("utf-8", "surrogatepass") for t, n in zip(pdf["text"], new, strict=True) if n]
        items: list[np.ndarray] = []
        for a, b in blocks(texts, _BATCH):
            hashes, counts = word_hashes(texts[a:b])
            items += [shingle_set(h, k).view(np.int64) for h in np.split(hashes, np.cumsum(counts)[:-1])]
        least = join_block(ids[new], items, left, right, num, den)
        keep = least != ids[new]
        return pd.DataFrame({"a": ids[new][keep], "b": least[keep]})

    return materialize(cells.groupBy("cluster", "lead", "blk").applyInPandas(run, "a long, b long"), label)


def classes(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text); component_id is the least doc_id reachable by links,
    which join documents that share num / den of the union of their ``k``-word shingles.

    A document without words has no shingles and links with nothing. Null text counts as empty. Rows with a null doc_id link with
    nothing and have a null component. Rows that repeat a doc_id are one node (n_shingles is each row's own).
    """
    small_batches(docs.sparkSession)
    known = pointed = materialize(_points(docs, k), "jpoints")
    real = known.where("doc_id is not null and n > 0")
    # Equal sets link; one of them stands for all. Rows of a large group are spread by a salt, and a group's least id goes to each salt it has.
    spread = real.select("doc_id", "n", "d1", "d2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    part = spread.groupBy("n", "d1", "d2", "salt").agg(F.min("doc_id").alias("rep"))
    same = part.groupBy("n", "d1", "d2").agg(F.min("rep").alias("rep"), F.collect_set("salt").alias("salts"))
    same = same.select("n", "d1", "d2", "rep", F.explode("salts").alias("salt"))
    rep = materialize(spread.join(same, ["n", "d1", "d2", "salt"]).select("doc_id", "rep").distinct(), "jrep")
    copies = rep.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("own")).where("not own").select("doc_id")
    few = copies.count() <= BROADCAST_IDS
    single = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")
    # A window, as the keys are then made and shuffled once; it streams a key's rows and spills.
    keys = _keys(single, k, num, den).withColumn("least", F.min("doc_id").over(Window.partitionBy("key")))
    near = materialize(keys.where("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct(), "jnear")
    cluster = materialize(connected_components(_candidates(near, real, num, den), "jcand").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "jclu")
    known = materialize(known.select("doc_id", "n"), "jsize")
    discard(pointed)
    discard(near)
    weight = known.groupBy("doc_id").agg(F.greatest(F.max("n"), F.lit(GROUPS)).alias("n")).join(cluster, "doc_id")
    size = weight.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    member = weight.join(size, "cluster").withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    member = materialize(member, "jmem")
    # Leaders: block 0 of each cluster, which meets itself and every other block.
    lead = _with_text(docs, member.select("doc_id", "cluster", "blocks", "blk").withColumn("lead", F.lit(0)))
    lead = lead.withColumn("blk", F.explode(F.when(F.col("blk") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("blk"))))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")) == 0
    found = _meet(lead.select("cluster", "lead", "blk", "doc_id", own.alias("left"), (~own | (F.col("blk") == 0)).alias("right"), "text"), "jlink", k, num, den)
    links = found
    if member.where("blocks > 1").limit(1).count():
        # What the leaders did not connect to the largest class of a cluster meets all blocks of it.
        cls = connected_components(found.select("a", "b"), "jcls")
        placed = member.where("blocks > 1").join(cls.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("cls", F.coalesce("component", "doc_id"))
        tally = placed.groupBy("cluster", "cls").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "cls")).alias("top"))
        rest = placed.join(tally, "cluster").where("cls <> top.cls and blk <> 0").select("doc_id", "cluster", "n")
        parts = rest.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
        rest = rest.join(parts, "cluster").select("doc_id", (1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts"))).cast("int").alias("part"))
        second = materialize(member.where("blocks > 1").join(parts, "cluster").join(rest, "doc_id", "left"), "jrest")
        rows = _with_text(docs, second)
        meets = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda p: F.struct(p.alias("lead"), F.col("blk").alias("blk"), (p == F.coalesce("part", F.lit(0))).alias("left"), F.lit(True).alias("right")))
        other = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.col("part").isNotNull() & (b != F.col("blk"))), lambda b: F.struct(F.col("part").alias("lead"), b.alias("blk"), F.lit(True).alias("left"), F.lit(False).alias("right")))
        cells = rows.withColumn("cell", F.explode(F.concat(meets, other))).select("cluster", "cell.lead", "cell.blk", "doc_id", "cell.left", "cell.right", "text")
        links = found.unionByName(_meet(cells, "jlink2", k, num, den))
    equal = rep.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = connected_components(links.select("a", "b").unionByName(equal), "jcomp")
    out = known.select("doc_id", F.col("n").alias("n_shingles")).join(comp, known["doc_id"] == comp["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs`` that stand for their class (least doc_id), all their columns kept; of rows that repeat a doc_id all stay."""
    gone = materialize(classes(docs, k, num, den).where("component_id <> doc_id").select("doc_id").distinct(), "jgone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
