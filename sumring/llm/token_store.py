"""Token ids in a binary format: canonical length-limited Huffman code from global counts, independent blocks, checkpoints.

File: segments one after another, each readable alone by byte range. A segment holds whole documents in ascending doc_id order:

    magic "HTK1", n_docs u32, n_tokens u32, n_bytes u32, then
    doc lengths u32[n_docs], checkpoints u32[ceil(n_tokens / BLOCK)] (bit offset of each block of ids), bit stream u8[n_bytes]

Decoding is by one table lookup of ``LIMIT`` bits per id, all blocks of a segment in lockstep. The code book is the list of code
lengths by id (0: unused), kept beside the files. Documents are tokenised once; the ids are counted over all of them, then written in
order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh_path, materialize, small_batches
from .store import Ranges, Writer

#: Longest code in bits (the decoding table has 2**LIMIT entries), ids per block, ids per segment.
LIMIT, BLOCK, SEGMENT = 18, 128, 1 << 20
#: Segments that a task decodes.
TASK = 16
#: Id that ends each document.
END = 1
#: Letter sequences, tails and other chunks in each of the two generations that a worker keeps.
CACHE = 400_000
#: What may follow the letters of a chunk, and chunks of letters that lower-casing alone normalises.
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
LETTERS = re.compile(LATIN).fullmatch
MAGIC = b"HTK1"


def id_width(vocabulary: int) -> np.dtype:
    """How ids are held between tokenising and the files."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


class Encoder:
    """Ids of texts by the tokenizers library.

    Where the file has the normaliser and pattern below, white space and every border between a letter and ASCII punctuation (but the
    apostrophe) end a word, so chunks are encoded apart, each once while it is cached: a chunk that is letters of Latin-1 and a tail of
    such punctuation as lower-cased letters, which need no normaliser, and tail. Chunks that may hold a special token stay whole. With
    any other file whole texts are encoded.
    """

    # The normaliser and the pattern of words that make chunks independent.
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.tok = Tokenizer.from_file(path)
        made = json.loads(self.tok.to_str())
        split = ((made["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.chunks = (made["normalizer"] or {}).get("normalizers") == self.NORMAL and split.get("pattern") == {"Regex": self.WORD} and all("|" in t["content"] and "<" in t["content"] for t in made["added_tokens"])
        if self.chunks:
            bare = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
            self.bare = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "added_tokens": [], "pre_tokenizer": bare}))
        self.width = id_width(self.tok.get_vocab_size(with_added_tokens=True))
        self.known = Kept(CACHE)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode(self, tok, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 20_000):
            out += [np.array(e.ids, self.width).tobytes() for e in tok.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)]
        return out

    def _new(self, keys: list[str]) -> list[bytes]:
        """Ids of what is not kept: lower-case letters, or chunks and tails as they are."""
        easy = [LETTERS(k) is not None for k in keys]
        parts = {e: iter(self._encode(self.bare if e else self.tok, [k for k, x in zip(keys, easy, strict=True) if x is e])) for e in (True, False)}
        return [next(parts[e]) for e in easy]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct chunks one after another, and how many each has."""
        stems = pc.utf8_rtrim(words, characters=PUNCTUATION)
        easy = pc.match_substring_regex(stems, f"^{LATIN}$")
        cut = np.where(easy.to_numpy(zero_copy_only=False), pc.binary_length(words).to_numpy() - pc.binary_length(stems).to_numpy(), 0)
        stems = pc.if_else(easy, pc.utf8_lower(stems), words).dictionary_encode()
        tails = endings(words, cut).dictionary_encode()
        heads = stems.dictionary.to_pylist()
        values = self.known.of(heads, self._new) + self.known.of(tails.dictionary.to_pylist(), self._new)
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.width.itemsize
        both = np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + len(heads)], 1).reshape(-1)
        return spliced(np.frombuffer(b"".join(values), self.width), size, both)[0], size[both].reshape(-1, 2).sum(1)

    def batch(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts (null: empty) one after another, each text closed by ``end``, and where each text ends."""
        texts = pc.fill_null(texts, "")
        if self.chunks:
            split = pc.ascii_split_whitespace(texts)
            offsets, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
            codes, last = coded.indices.to_numpy(), offsets[1:] - offsets[0]
            pool, size = self._words(coded.dictionary)
        else:
            values = self._encode(self.tok, texts.to_pylist())
            codes, last = np.arange(len(texts)), np.arange(1, len(texts) + 1)
            pool, size = np.frombuffer(b"".join(values), self.width), np.fromiter(map(len, values), np.int64, len(values)) // self.width.itemsize
        ids, ends = spliced(np.append(pool, self.width.type(end)), np.append(size, 1), np.insert(codes, last, len(size)))
        return ids, ends[last + np.arange(len(last))]

    def __call__(self, texts: list[str], end: int = END) -> list[bytes]:
        """The ids of each text, its end included, as little-endian u32 bytes."""
        ids, ends = self.batch(pa.array(texts, pa.string()), end)
        return [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])]


def spliced(pool: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``codes`` of a pool that holds runs of ``size`` elements, one after another, and where each ends."""
    n = size[codes]
    ends = np.cumsum(n)
    return pool[np.repeat((np.cumsum(size) - size)[codes] - (ends - n), n) + np.arange(n.sum())], ends


def endings(texts: pa.Array, n: np.ndarray) -> pa.Array:
    """The last ``n`` bytes of each text, which begin and end characters."""
    if not n.any():
        return pa.array([""] * len(texts), pa.string())
    _, offsets, data = texts.buffers()
    stop = np.frombuffer(offsets, np.int32)[texts.offset + 1 : texts.offset + 1 + len(texts)].astype(np.int64)
    ends = np.cumsum(n)
    got = np.frombuffer(data, np.uint8)[np.repeat(stop - ends, n) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(got)])


class Kept:
    """Values by key in two generations of about ``most`` keys; what is used again moves to the younger one."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def of(self, keys: list, make) -> list:
        """The value of each of ``keys``, which are distinct; those that are not kept are made together."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        out = list(map(self.young.get, keys))
        for i in [i for i, v in enumerate(out) if v is None]:
            got = self.old.get(keys[i])
            if got is not None:
                out[i] = self.young[keys[i]] = got
        new = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(new, make([keys[i] for i in new]), strict=True):
            out[i] = self.young[keys[i]] = v
        return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur. One id alone gets one bit."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) <= 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[ids].astype(np.float64)
    # At each level, merge the leaves with the packages (pairs) of the level below; is_leaf remembers which is which.
    merged, levels = weight, []
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weight))
        merged = both[order]
    take, lengths = 2 * len(ids) - 2, np.zeros(len(ids), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[:take] += 1
    out[ids] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id), as numbers of ``lengths`` bits."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort([np.arange(len(lengths)), lengths])
    order = order[lengths[order] > 0]
    if not len(order):
        return codes
    n = lengths[order].astype(np.uint64)
    top = int(n.max())
    begin = np.concatenate([[0], np.cumsum(np.uint64(1) << (np.uint64(top) - n))[:-1]]).astype(np.uint64)
    codes[order] = begin >> (np.uint64(top) - n)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, code length) of each window of ``width`` bits, and the width."""
    width = max(1, int(lengths.max(initial=0)))
    ids, bits = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used] << (np.uint64(width) - lengths[used].astype(np.uint64)), kind="stable")]
    span = (1 << (width - lengths[used].astype(np.int64))).astype(np.int64)
    ids[: span.sum()], bits[: span.sum()] = np.repeat(used, span), np.repeat(lengths[used], span)
    return ids, bits, width


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Bit stream (most significant bit first) and the bit offset of each block."""
    n = lengths[ids].astype(np.uint64)
    ends = np.cumsum(n, dtype=np.uint64)
    at = ends - n
    total = int(ends[-1]) if len(ids) else 0
    word, shift = (at >> np.uint64(5)).astype(np.int64), at & np.uint64(31)
    value = codes[ids] << (np.uint64(64) - n - shift)  # codes of up to 32 bits span two words at most
    size = total // 32 + 2
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)[:size]
    return words.astype(">u4").tobytes()[: (total + 7) // 8], at[::block].astype("<u4")


def unpack(stream: bytes, checkpoints: np.ndarray, n: int, table: tuple, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids; all blocks advance together, one id each a step."""
    ids, bits, width = table
    data = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint64)
    padded = np.concatenate([data, np.zeros(4, np.uint64)])
    window = (padded[:-4] << np.uint64(32)) | (padded[1:-3] << np.uint64(24)) | (padded[2:-2] << np.uint64(16)) | (padded[3:-1] << np.uint64(8)) | padded[4:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((block, len(at)), np.uint32)
    mask, last = (1 << width) - 1, len(window) - 1
    for i in range(block):
        w = window[np.minimum(at >> 3, last)] >> (40 - width - (at & 7)).astype(np.uint64)
        w = (w & np.uint64(mask)).astype(np.int64)
        out[i] = ids[w]
        at = at + bits[w]
    return out.T.reshape(-1)[:n]


def segment(docs: list[bytes], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    width = id_width(len(lengths))
    ids = np.frombuffer(b"".join(docs), width)
    stream, checkpoints = pack(ids, lengths, codes)
    return struct.pack("<4sIII", MAGIC, len(docs), len(ids), len(stream)) + np.array([len(d) // width.itemsize for d in docs], "<u4").tobytes() + checkpoints.tobytes() + stream


def open_segment(data: bytes, table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(document lengths, ids)."""
    magic, n_docs, n, size = struct.unpack_from("<4sIII", data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    lens = np.frombuffer(data, "<u4", n_docs, 16)
    marks = np.frombuffer(data, "<u4", -(-n // BLOCK), 16 + 4 * n_docs)
    begin = 16 + 4 * n_docs + 4 * len(marks)
    return lens, unpack(data[begin : begin + size], marks, n, table)


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and all ids of each document (end included) as little-endian numbers of ``Encoder.width``, written once for the counts and
    the files."""

    def run(it):
        enc = Encoder.of(tokenizer)
        for rows in it:
            ids, ends = enc.batch(rows.column(1))
            offsets = np.concatenate([[0], ends]) * enc.width.itemsize
            if offsets[-1] < 1 << 31:
                column = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.column(0), column], ["doc_id", "ids"])
            else:  # texts so long that their ids pass what one batch holds
                for k, x in enumerate(np.split(ids, ends[:-1])):
                    yield pa.RecordBatch.from_arrays([rows.column(0).slice(k, 1), pa.array([x.tobytes()], pa.binary())], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary"), "tokids")


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Counts of all ids over all documents, ends included; the result is bounded by the vocabulary."""
    width = id_width(vocabulary)

    def run(it):
        total = np.zeros(vocabulary, np.int64)
        for rows in it:
            total += np.bincount(np.frombuffer(b"".join(rows.column(0).to_pylist()), width), minlength=vocabulary)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocabulary, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_tokens(tokens: DataFrame, folder: str, lengths: np.ndarray) -> DataFrame:
    """Write all documents in ascending doc_id order (nulls first; rows that repeat a doc_id by the bytes of their ids); a file per task, in a range of ids of its own. Returns the index:
    uri, offset, length, part, seg, n_docs, n_tokens and the doc_ids of each segment."""
    codes, width = canonical(lengths), id_width(len(lengths)).itemsize

    def run(it):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out, held, ids, size, seg = None, [], [], 0, 0
        for pdf in it:
            rows = []
            for doc_id, got in zip(pdf["doc_id"], pdf["ids"], strict=True):
                if held and size + len(got) // width > SEGMENT:
                    data = segment(held, lengths, codes)
                    rows.append((out.uri, out.write(data), len(data), part, seg, len(held), size, ids))
                    held, ids, size, seg = [], [], 0, seg + 1
                out = out or Writer(folder, ".htk")
                held.append(got)
                ids.append(doc_id)
                size += len(got) // width
            yield pd.DataFrame(rows, columns=COLS)
        if held:
            data = segment(held, lengths, codes)
            yield pd.DataFrame([(out.uri, out.write(data), len(data), part, seg, len(held), size, ids)], columns=COLS)
        if out is not None:
            out.close()

    COLS = ["uri", "offset", "length", "part", "seg", "n_docs", "n_tokens", "doc_ids"]
    rows = tokens.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("_k"), "ids").repartitionByRange(F.col("_k").asc_nulls_first()).sortWithinPartitions(F.col("_k").asc_nulls_first(), "ids").drop("_k")
    return materialize(rows.mapInPandas(run, "uri string, offset long, length long, part int, seg int, n_docs long, n_tokens long, doc_ids array<string>"), "tokidx")


def read_tokens(index: DataFrame, lengths: np.ndarray, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the files. ``start`` follows from the token sums of the
    files before (one row a file) and of the segments before within the file."""
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("file_start"))
    within = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    rows = index.withColumn("seg_start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(before, "part")
    rows = rows.select("uri", "offset", "length", (F.col("file_start") + F.col("seg_start")).alias("start"), "doc_ids").repartitionByRange(-(-max(1, index.count()) // TASK), "uri", "offset").sortWithinPartitions("uri", "offset")

    def run(it):
        ranges, table = Ranges(), decoding_table(lengths)
        for pdf in it:
            for uri, offset, length, start, doc_ids in pdf.itertuples(index=False, name=None):
                lens, ids = open_segment(ranges.read(uri, offset, length), table)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lens, dtype=np.int64)
                begins = ends - lens
                out = {"doc_id": list(doc_ids), "start": start + begins, "n_tokens": lens.astype(np.int64), "ids_crc32": [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins, ends, strict=True)]}
                if not digest_only:
                    out["ids"] = [ids[b:e].astype(np.int64) for b, e in zip(begins, ends, strict=True)]
                yield pd.DataFrame(out)
        ranges.close()

    out = rows.mapInPandas(run, "doc_id string, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>"))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary = Encoder.of(tokenizer).tok.get_vocab_size(with_added_tokens=True)
    tokens = encoded(docs, tokenizer)
    lengths = code_lengths(count_ids(tokens, vocabulary))
    index = write_tokens(tokens, fresh_path(spark, "tokens"), lengths)
    discard(tokens)
    return read_tokens(index, lengths, digest_only=True)
