"""LM scoring by online logistic context mixing.

A text is predicted bit by bit. For each context (the last 1, 2, 3, 4 and 6 bytes) a slot holds how often each byte followed, and so, for
each prefix of its bits, each bit. A predictor's output is the stretched probability ln((n1 + d) / (n0 + d)). The mixer adds the outputs
with weights chosen by a gate (how many contexts know the bits so far, and these bits); weights are learnt online, by AdaGrad steps on
coding cost. An adaptive map (bits so far, stretched probability -> observed frequency) refines the result. The log10 probability of a
text is the sum over its bits and an end symbol (byte 0xFF, which UTF-8 never has), in units of 1 / ``UNIT`` for each byte.

Counts are kept by ``gram``: the last 6 bytes and the byte that follows, as one number. Contexts of 3, 4 and 6 bytes are routed by a hash
of their last 3 bytes, so that a part holds whole slots of all three; those of 1 and 2 bytes are one table of at most 256**3 entries, which
is broadcast. Training occurrences are learnt from against the counts of all others (their own is taken out), each as often as it occurs.

Distribution: documents are cut into chunks; a chunk sends its distinct grams and tokens, with its own training counts, by parts. A part
sums them, learns, and later answers with the cost of each gram and the count of each token; a chunk then adds up its documents. Nothing
depends on how the input is partitioned: a part sees its grams in hashed order, and costs are whole numbers. What is gathered grows with
the corpus and is never in one place; a task holds one chunk or one part.

Edges: null text counts as empty; an empty text has its end symbol and end token only; a very long text is worked on in windows; repeated
rows are scored each; null and repeated ids are kept as they are; without training rows all counts are 0; an empty table gives an empty
result; columns other than doc_id and text (and a condition for training) are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, fresh_path, materialize, small_batches, worker_tables
from .store import Ranges, Writer
from .wordhash import mix, word_hashes

#: Contexts, in bytes; the longest is the gram's.
ORDERS = (1, 2, 3, 4, 6)
M = ORDERS[-1]
#: Bytes of text in a chunk, and for which there is a part; a small corpus is cut into about ``CHUNKS`` chunks and ``PARTS`` parts.
CHUNK, PART, CHUNKS, PARTS = 8 << 20, 32 << 20, 16, 12
#: Bytes that are worked on at once, grams whose predictions are.
WINDOW, SLICE = 1 << 20, 1 << 15
#: Count added to both bits; AdaGrad rate, start weight, grams of a step, passes within a part, rounds of averaging over parts.
DELTA, RATE, START, STEP, PASSES, ROUNDS = 0.15, 0.05, 0.3, 512, 2, 2
#: Bytes before each text, and after it.
PAD, END = 0xFE, 0xFF
#: Bounds of stretched probability in the mixer and in the map, buckets of the map; a symbol's cost is a whole number of log10 / UNIT.
LIMIT, BOUND, BUCKETS, UNIT = 12.0, 8.0, 65, 1 << 16

N, GATES = len(ORDERS), (len(ORDERS) + 1) * 256
_BYTE = np.arange(256)
#: Node (1..255, the bits so far with a leading 1) and bit at each of the 8 steps of a byte.
_NODE = np.stack([(1 << k) | (_BYTE >> (8 - k)) for k in range(8)], 1)
_BIT = np.stack([(_BYTE >> (7 - k)) & 1 for k in range(8)], 1).astype(bool)
_U = np.uint64


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """By the last three bytes of the context."""
    return (mix(grams >> _U(8 * (M - 2))) % _U(parts)).astype(np.int64)


def shorter(grams: np.ndarray, order: int) -> np.ndarray:
    """The gram's last ``order`` bytes of context, and its byte."""
    return grams if order == M else ((grams >> _U(8 * (M - order + 1))) << _U(8)) | (grams & _U(255))


def windows(texts: list[bytes]):
    """Grams of all coded bytes, in order, window by window: the byte last read is the highest of the context, so that sorted grams keep
    every shorter context together."""
    head, tail = bytes([PAD]) * 8, bytes([END])
    flat = np.frombuffer(b"".join([head, *(x for t in texts for x in (head[:M], t, tail))]), np.uint8)
    for a in range(8, len(flat), WINDOW):
        part = flat[a - 7 : a + WINDOW]
        eight = np.ndarray(len(part) - 7, np.dtype("<u8"), part.tobytes(), 0, (1,))[part[7:] != PAD]
        yield (((eight << _U(8)) >> _U(8 * (8 - M))) << _U(8)) | (eight >> _U(56))


class Chunk:
    """Distinct keys of a chunk in order of (part, key): grams, or tokens (``of`` gives the part), found window by window."""

    def __init__(self, found: list[np.ndarray], of, parts: int):
        codes, keys = pd.factorize(np.concatenate(found) if found else np.zeros(0, np.uint64))
        part = of(keys, parts)
        order = np.lexsort([keys, part])
        self.place = np.empty(len(keys), np.int32)
        self.place[order] = np.arange(len(keys), dtype=np.int32)
        self.place = self.place[codes]
        self.keys, self.part = keys[order], part[order]

    def rows(self, kind: int, chunk: int, counts: np.ndarray) -> list[tuple]:
        total = np.bincount(self.place, counts, len(self.keys)).astype(np.uint64)
        parts, begin = np.unique(self.part, return_index=True)
        return [(kind, p, chunk, b - a, pack_keys(self.keys[a:b]), _planes(total[a:b]), None, None) for p, a, b in zip(parts.tolist(), begin, [*begin[1:], len(self.keys)], strict=True)]


def gram_windows(texts: list[bytes]) -> tuple[list, list]:
    """(codes, distinct grams) of each window."""
    codes, found = [], []
    for grams in windows(texts):
        c, u = pd.factorize(grams)
        codes.append(c.astype(np.int32))
        found.append(u)
    return codes, found


def _token_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % _U(parts)).astype(np.int64)


def nodes(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(9, grams): how often the context of each of the sorted grams was followed by the first 0 to 8 bits of its byte."""
    out = np.empty((9, len(grams)), np.float32)
    for j in range(9):
        prefix = grams >> _U(8 - j)
        new = np.r_[True, prefix[1:] != prefix[:-1]]
        out[j] = np.add.reduceat(counts, np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams, where each of ``grams`` is among them, and their counts."""
    found, at = np.unique(grams, return_inverse=True)
    return found, at.astype(np.int32), np.bincount(at, counts, len(found))


class Slots:
    """Slots of a part's grams in all contexts. ``low``: sorted grams and counts of the contexts of two bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]):
        self.byte, self.counts = (grams & _U(255)).astype(np.int64), counts
        self.at, self.sums = [], []
        for order in ORDERS:
            own = shorter(grams, order)
            if order <= 2:  # the slots of a short context are everywhere; only those that this part asks for are kept
                short = low[0] if order == 2 else ((low[0] >> _U(16)) << _U(8)) | (low[0] & _U(255))
                asked = np.unique(own)
                found, _, total = summed(np.concatenate([short, asked]), np.concatenate([low[1], np.zeros(len(asked))]))
                at = np.searchsorted(found, own).astype(np.int32)
            else:
                found, at, total = summed(own, counts)
            self.at.append(at)
            self.sums.append(nodes(found, total))

    def outputs(self, which: np.ndarray, own: float) -> tuple[list[np.ndarray], np.ndarray]:
        """For each context the outputs towards the bits taken, (grams, 8), and the gate of each bit; ``own`` occurrences of each gram are left
        out."""
        out, known = [], np.zeros((len(which), 8), np.int64)
        for at, sums in zip(self.at, self.sums, strict=True):
            n = sums[:, at[which]]
            taken, other = n[1:] - np.float32(own), n[:-1] - n[1:]
            known += (taken + other > 0).T
            out.append(np.log((taken + np.float32(DELTA)) / (other + np.float32(DELTA))).T)
        return out, known * 256 + _NODE[self.byte[which]]


class Mixer:
    """Gated weights, and the adaptive map's counts."""

    def __init__(self, weights: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.w = np.full((N, GATES), START) if weights is None else weights.copy()
        self.seen = np.zeros((256 * BUCKETS, 2)) if seen is None else seen
        self.mass = np.zeros(GATES)

    def mixed(self, outputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        return np.clip(sum(self.w[i][gate] * outputs[i] for i in range(N)), -LIMIT, LIMIT)

    def learn(self, slots: Slots, which: np.ndarray) -> None:
        """Online, over the grams ``which``: step by step, predict, then move the weights down the gradient of the cost."""
        past = np.full((N, GATES), 1e-3)
        for turn in range(PASSES):
            for a in range(0, len(which), SLICE):
                outputs, gate = slots.outputs(which[a : a + SLICE], 1.0)
                count = np.repeat(slots.counts[which[a : a + SLICE]], 8).reshape(gate.shape)
                if not turn:
                    self.mass += np.bincount(gate.reshape(-1), count.reshape(-1), GATES)
                for b in range(0, len(gate), STEP):
                    g, x = gate[b : b + STEP].reshape(-1), [v[b : b + STEP].reshape(-1) for v in outputs]
                    miss = count[b : b + STEP].reshape(-1) / (1 + np.exp(self.mixed(x, g)))
                    for i in range(N):
                        grad = np.bincount(g, miss * x[i], GATES)
                        past[i] += grad * grad
                        self.w[i] += RATE * grad / np.sqrt(past[i])

    def observe(self, slots: Slots, which: np.ndarray) -> None:
        """Count for the map, with the weights as they are."""
        for a in range(0, len(which), SLICE):
            some = which[a : a + SLICE]
            cell, bit = self._cells(self.mixed(*slots.outputs(some, 1.0)), slots.byte[some])
            self.seen += np.bincount((cell * 2 + bit).reshape(-1), np.repeat(slots.counts[some], 8), self.seen.size).reshape(self.seen.shape)

    @staticmethod
    def _cells(z: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bit = _BIT[byte]
        bucket = np.rint((np.clip(np.where(bit, z, -z), -BOUND, BOUND) + BOUND) * ((BUCKETS - 1) / (2 * BOUND))).astype(np.int64)
        return _NODE[byte] * BUCKETS + bucket, bit

    def costs(self, slots: Slots, which: np.ndarray) -> np.ndarray:
        """Cost of each of the grams, in log10 / UNIT."""
        middle = 1 / (1 + np.exp(-np.linspace(-BOUND, BOUND, BUCKETS)))
        one = np.clip((self.seen[:, 1] + 32 * np.tile(middle, 256)) / (self.seen.sum(1) + 32), 2.0**-16, 1 - 2.0**-16)
        out = np.empty(len(which), np.uint32)
        for a in range(0, len(which), SLICE):
            some = which[a : a + SLICE]
            z = self.mixed(*slots.outputs(some, 0.0))
            cell, bit = self._cells(z, slots.byte[some])
            refined = np.where(bit, one[cell], 1 - one[cell])
            out[a : a + SLICE] = np.rint(-np.log10((1 / (1 + np.exp(-z)) + refined) / 2).sum(1) * UNIT)
        return out


def _zstd(x: bytes) -> bytes:
    import pyarrow as pa

    return pa.compress(x, codec="zstd", asbytes=True)


def _unzstd(x: bytes, size: int) -> bytes:
    import pyarrow as pa

    return pa.decompress(x, decompressed_size=size, codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Compressed numbers, byte by byte of equal rank."""
    return _zstd(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unplanes(blob: bytes, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(_unzstd(blob, n * width), np.uint8).reshape(width, n).T).reshape(-1).view(dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences."""
    return _planes(np.diff(keys, prepend=_U(0)))


def unpack_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplanes(blob, n, np.uint64), dtype=np.uint64)


def _texts(col) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in col]


def _pack(rows: list[tuple]) -> bytes:
    import pyarrow as pa

    ids, texts, train = zip(*rows, strict=True)
    batch = pa.record_batch([pa.array(ids, pa.string(), from_pandas=True), pa.array(texts, pa.large_binary()), pa.array([bool(x) for x in train])], names=["i", "t", "x"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpack(data: bytes) -> tuple[list, list[bytes]]:
    import pyarrow as pa

    ids, texts, _ = pa.ipc.open_stream(data).read_all().columns
    return ids.to_pylist(), texts.to_pylist()


GRAM, TOKEN = 1, 2
_CHUNKED = "kind int, part long, chunk long, n long, keys binary, counts binary, uri string, at long"
_TOTALS = "kind int, part long, n long, total long, keys binary, counts binary, chunks array<long>, sizes array<long>, blobs array<binary>"


def _chunked(docs: DataFrame, most: int, parts: int) -> DataFrame:
    """One pass over ``docs`` (doc_id, text, train): for each chunk where its documents are kept (kind 0; n: bytes, part: training documents), and by
    part its distinct grams and tokens with their counts in training documents."""
    folder = fresh_path(docs.sparkSession, "lmtext")

    def run(it):
        from pyspark import TaskContext

        worker_tables()
        chunk, out = TaskContext.get().partitionId() << 32, None
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal out
            out = out or Writer(folder, ".texts")
            data = _pack(held)
            texts, train = [t for _, t, _ in held], np.array([x for _, _, x in held], bool)
            rows = [(0, int(train.sum()), chunk, len(data), None, None, out.uri, out.write(data))]
            codes, found = gram_windows(texts)
            ends, at, counts = np.cumsum([len(t) + 1 for t in texts]), 0, []
            for c, u in zip(codes, found, strict=True):
                doc = np.searchsorted(ends, np.arange(at, at + len(c)), "right") if not train.all() else None
                counts.append(np.bincount(c if doc is None else c[train[doc]], minlength=len(u)))
                at += len(c)
            del codes
            rows += Chunk(found, part_of, parts).rows(GRAM, chunk, np.concatenate(counts))
            hashes, words = word_hashes(texts)
            rows += Chunk([hashes], _token_part, parts).rows(TOKEN, chunk, np.repeat(train, words))
            return pd.DataFrame(rows, columns=[x.split()[0] for x in _CHUNKED.split(", ")])

        for pdf in it:
            for i, t, x in zip(pdf["doc_id"], _texts(pdf["text"]), pdf["train"], strict=True):
                held.append((i, t, x))
                size += len(t) + 1
                if size >= most:
                    yield flush()
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield flush()
        if out is not None:
            out.close()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "train").mapInPandas(run, _CHUNKED)


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One part: its keys with the counts of all, and for each chunk (tables of a model have none) where its keys are among them or, for
    tokens, their counts."""
    keys = [unpack_keys(k, n) for k, n in zip(pdf["keys"], pdf["n"], strict=True)]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unplanes(c, n, np.uint64) for c, n in zip(pdf["counts"], pdf["n"], strict=True)])
    total = np.zeros(len(found), np.uint64)
    np.add.at(total, at, counts)
    kind, chunks, sizes, blobs, cut = int(pdf["kind"].iloc[0]), [], [], [], 0
    for chunk, own in zip(pdf["chunk"], keys, strict=True):
        place = at[cut : cut + len(own)]
        cut += len(own)
        if chunk >= 0:
            chunks.append(chunk)
            sizes.append(len(own))
            blobs.append(_planes(np.diff(place, prepend=0).astype(np.uint32)) if kind == GRAM else _planes(total[place]))
    row = {"kind": kind, "part": int(pdf["part"].iloc[0]), "n": len(found), "total": int(total.sum()), "keys": pack_keys(found), "counts": _planes(total), "chunks": chunks, "sizes": sizes, "blobs": blobs}
    return pd.DataFrame({k: [v] for k, v in row.items()})


def _totals(chunked: DataFrame, model: DataFrame | None = None) -> DataFrame:
    rows = chunked.where("kind > 0").select("kind", "part", "chunk", "n", "keys", "counts")
    if model is not None:
        rows = rows.unionByName(model.select("kind", "part", F.lit(-1).cast("long").alias("chunk"), "n", "keys", "counts"))
    return materialize(rows.groupBy("kind", "part").applyInPandas(_summed, _TOTALS), "lmtotals")


def _low(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams of two bytes of context, with their counts: at most 256**3."""

    def run(it):
        for pdf in it:
            for n, keys, counts in zip(pdf["n"], pdf["keys"], pdf["counts"], strict=True):
                found, _, total = summed(shorter(unpack_keys(keys, n), 2), _unplanes(counts, n, np.uint64))
                yield pd.DataFrame({"g": found.astype(np.int64), "c": total.astype(np.int64)})

    rows = totals.where(F.col("kind") == GRAM).select("n", "keys", "counts").mapInPandas(run, "g long, c long")
    got = rows.groupBy("g").agg(F.sum("c").alias("c")).where("c > 0").toPandas().sort_values("g")
    return got["g"].to_numpy(np.int64).view(np.uint64), got["c"].to_numpy(float)


def _trained(keys: bytes, counts: bytes, n: int, low) -> tuple[Slots, np.ndarray]:
    """Slots of a part, and its training grams in hashed order."""
    grams, c = unpack_keys(keys, n), _unplanes(counts, n, np.uint64).astype(float)
    which = np.flatnonzero(c)
    return Slots(grams, c, low), which[np.argsort(mix(grams[which]))]


def _over_parts(totals: DataFrame, low, weights: np.ndarray | None, observe: bool) -> np.ndarray | None:
    """Sum over parts of the weights by mass, learnt from ``weights`` on, and of the masses; or of the map's counts."""
    bc = totals.sparkSession.sparkContext.broadcast((low, weights))

    def run(it):
        worker_tables()
        total = 0
        for pdf in it:
            for n, keys, counts in zip(pdf["n"], pdf["keys"], pdf["counts"], strict=True):
                low, weights = bc.value
                mixer, (slots, which) = Mixer(weights), _trained(keys, counts, n, low)
                if not len(which):
                    continue
                if observe:
                    mixer.observe(slots, which)
                    total = total + mixer.seen.reshape(-1)
                else:
                    mixer.learn(slots, which)
                    total = total + np.concatenate([(mixer.w * mixer.mass).reshape(-1), mixer.mass])
        if not np.isscalar(total):
            yield pd.DataFrame({"x": [_zstd(total.tobytes())]})

    def add(it):
        total = 0
        for pdf in it:
            for x in pdf["x"]:
                total = total + np.frombuffer(_unzstd(x, 8 * ((N + 1) * GATES if not observe else 512 * BUCKETS)))
        if not np.isscalar(total):
            yield pd.DataFrame({"x": [_zstd(total.tobytes())]})

    sums = totals.where(F.col("kind") == GRAM).select("n", "keys", "counts").mapInPandas(run, "x binary")
    got = sums.repartition(1).mapInPandas(add, "x binary").collect()  # a fixed size for each task
    return np.frombuffer(_unzstd(bytes(got[0]["x"]), 8 * ((N + 1) * GATES if not observe else 512 * BUCKETS))) if got else None


def train_model(docs: DataFrame, train=None) -> dict:
    """Learn from the rows of ``docs`` (doc_id, text) where ``train`` holds (all by default): returns weights and map, the table of grams and
    tokens by part, and what is needed to score ``docs`` itself."""
    small_batches(docs.sparkSession)
    docs = docs.withColumn("train", F.lit(True) if train is None else train)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    most, parts = max(1 << 12, min(CHUNK, size // CHUNKS)), max(PARTS, size // PART)
    chunked = materialize(_chunked(docs, most, parts), "lmchunks")
    totals = _totals(chunked)
    refs = materialize(chunked.where("kind = 0").select("chunk", "uri", "at", "n", "part"), "lmrefs")
    discard(chunked)
    ends = refs.agg(F.coalesce(F.sum("part"), F.lit(0))).first()[0]
    tokens = totals.where(F.col("kind") == TOKEN)
    n = tokens.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    low = _low(totals)
    weights, mixer = None, Mixer()
    for _ in range(ROUNDS):
        got = _over_parts(totals, low, weights, False)
        if got is not None:
            summed_w, mass = got[:-GATES].reshape(N, GATES), got[-GATES:]
            weights = np.round(np.where(mass > 0, summed_w / np.maximum(mass, 1), START), 9)  # of sums in any order
    if weights is not None:
        mixer = Mixer(weights, _over_parts(totals, low, weights, True).reshape(-1, 2))
    return {"refs": refs, "totals": totals, "most": most, "parts": parts, "low": low, "weights": mixer.w, "seen": mixer.seen, "n": int(n + ends), "v": int(_distinct(tokens) + (ends > 0)), "ends": int(ends), "id": docs.schema["doc_id"].dataType}


def _distinct(tokens: DataFrame) -> int:
    """Tokens that training documents have."""

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"v": [int(np.count_nonzero(_unplanes(c, n, np.uint64))) for n, c in zip(pdf["n"], pdf["counts"], strict=True)]})

    return tokens.select("n", "counts").mapInPandas(run, "v long").agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]


def score_documents(docs: DataFrame | None, m: dict) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), or without it of what ``train_model`` was given."""
    spark = m["totals"].sparkSession
    small_batches(spark)
    parts, refs, totals = m["parts"], m["refs"], m["totals"]
    id_type = m["id"] if docs is None else docs.schema["doc_id"].dataType
    if docs is not None:
        chunked = materialize(_chunked(docs.withColumn("train", F.lit(False)), m["most"], parts), "lmslots")
        refs, totals = chunked.where("kind = 0").select("chunk", "uri", "at", "n"), _totals(chunked, m["totals"])
    bc = spark.sparkContext.broadcast({k: m[k] for k in ("weights", "seen", "low")})
    base = m["n"] + 0.1 * (m["v"] + 1)
    end_score, end_known = float(np.log10((m["ends"] + 0.1) / base)), int(m["ends"] > 0)

    def answer(it):
        worker_tables()
        mixer = Mixer(bc.value["weights"], bc.value["seen"])
        for pdf in it:
            for row in pdf.itertuples(index=False):
                if not len(row.chunks):
                    continue
                grams, counts = unpack_keys(row.keys, row.n), _unplanes(row.counts, row.n, np.uint64).astype(float)
                cost = mixer.costs(Slots(grams, counts, bc.value["low"]), np.arange(len(grams)))
                for chunk, size, blob in zip(row.chunks, row.sizes, row.blobs, strict=True):
                    yield pd.DataFrame({"chunk": [chunk], "kind": [GRAM], "part": [row.part], "n": [size], "blob": [_planes(cost[np.cumsum(_unplanes(blob, size, np.uint32))])]})

    costs = totals.where(F.col("kind") == GRAM).select("part", "n", "keys", "counts", "chunks", "sizes", "blobs").mapInPandas(answer, "chunk long, kind int, part long, n long, blob binary")
    tokens = totals.where(F.col("kind") == TOKEN).select("part", F.explode(F.arrays_zip("chunks", "sizes", "blobs")).alias("x")).select(F.col("x.chunks").alias("chunk"), F.lit(TOKEN).alias("kind"), "part", F.col("x.sizes").alias("n"), F.col("x.blobs").alias("blob"))
    where = refs.select("chunk", F.lit(0).alias("kind"), F.col("at").alias("part"), "n", F.col("uri").cast("binary").alias("blob"))
    both = where.unionByName(costs).unionByName(tokens).repartition("chunk").sortWithinPartitions("chunk", "kind", "part")

    def finish(ref, costs: list[np.ndarray], counts: list[np.ndarray], ranges: Ranges) -> pd.DataFrame:
        uri, at, n = ref
        ids, texts = _unpack(ranges.read(uri, at, n))
        codes, found = gram_windows(texts)
        place, cost = Chunk(found, part_of, parts).place, np.concatenate(costs)
        ends, done, cut, at_ends, total = np.cumsum([len(t) + 1 for t in texts]), 0, 0, [], 0
        for c, u in zip(codes, found, strict=True):
            so_far = np.cumsum(cost[place[cut : cut + len(u)]].astype(np.int64)[c])
            own = ends[(ends > done) & (ends <= done + len(c))] - done - 1
            at_ends.append(total + so_far[own])
            cut, done, total = cut + len(u), done + len(c), total + int(so_far[-1])
        score = np.diff(np.concatenate(at_ends), prepend=0) / -UNIT
        hashes, words = word_hashes(texts)
        c = np.concatenate([*counts, np.zeros(0, np.uint64)])[Chunk([hashes], _token_part, parts).place].astype(float)
        stop = np.cumsum(words)
        logs, known = np.concatenate([[0.0], np.cumsum(np.log10((c + 0.1) / base))]), np.concatenate([[0], np.cumsum(c > 0)])
        return pd.DataFrame({"doc_id": ids, "n_tokens": words + 1, "n_known": known[stop] - known[stop - words] + end_known, "base_score": logs[stop] - logs[stop - words] + end_score, "score": score, "bytes": [len(t) for t in texts]})

    def score(it):
        worker_tables()
        ranges, now, ref = Ranges(), None, None
        got: dict[int, list] = {GRAM: [], TOKEN: []}
        for pdf in it:
            for row in pdf.itertuples(index=False):
                if row.chunk != now:
                    if now is not None:
                        yield finish(ref, got[GRAM], got[TOKEN], ranges)
                    now, got = row.chunk, {GRAM: [], TOKEN: []}
                if row.kind == 0:
                    ref = (row.blob.decode(), row.part, row.n)
                else:
                    got[row.kind].append(_unplanes(row.blob, row.n, np.uint32 if row.kind == GRAM else np.uint64))
        if now is not None:
            yield finish(ref, got[GRAM], got[TOKEN], ranges)
        ranges.close()

    out = both.mapInPandas(score, "doc_id string, n_tokens long, n_known long, base_score double, score double, bytes long").withColumn("doc_id", F.col("doc_id").cast(id_type))
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(m["n"]).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest(F.col("bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(None, train_model(docs, crc_mod(F.col("doc_id"), 10) != 0))
