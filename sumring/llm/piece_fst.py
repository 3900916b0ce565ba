"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model file: the normaliser (as the file's settings say: dummy prefix, extra spaces, space to U+2581),
the pieces (a trie whose final states emit an id) and the byte fallback (a character no piece covers emits its UTF-8 bytes). An input is a
chain automaton. The normaliser is deterministic, so its composition with the input is one chain again; that is composed on the fly with
the union of the other two, and the best path in the tropical semiring (min, +) gives the ids. Settings that these machines do not cover (a
character map, white space as suffix, word and character models, user-defined pieces) are refused.

For a BPE model the machine has a state per last piece, and an arc from piece s to piece t exists only if BPE itself splits the text
of s + t into s, t. By that locality of BPE exactly one path is accepted, the encoding (arc weight: 1 a piece). For a unigram model one
state is enough and an arc weighs minus the log-probability. The machine runs once per distinct segment; merges never cross the
start of a run of U+2581 nor a character that is in no longer piece, so texts are cut there.

Scale: one scan, no shuffle; a worker's tables are bounded by the vocabulary, ``PAIRS`` and twice ``CACHE`` bytes of segments.

Edges: null text counts as empty, which has no ids; a very long text is read whole, segment by segment; repeated rows are encoded each;
of paths of equal weight the one found first from the left is taken; an empty table gives an empty result; columns kept from the input
pass untouched, those named like a new one are replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, worker_tables

#: Bytes, as estimated, of the segments of each of the two generations that a worker keeps (what is used again moves to the younger one);
#: characters of the longest segment kept; piece pairs.
CACHE, KEEP = 80 << 20, 200
PAIRS = 1_000_000
MARK = "▁"


def wire(data: bytes) -> dict[int, list]:
    """Fields of a protocol-buffer message by number: whole numbers, and bytes of strings, messages and fixed-width numbers."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value = data[at : at + size]
            at += size
        out.setdefault(key >> 3, []).append(value)
    return out


class Normaliser:
    """A deterministic transducer over characters. ``arcs[state]``: character -> (output, next state); the key None stands for any other
    character, which is copied after the output. ``ends[state]``: what is put out at the end."""

    def __init__(self, prefix: bool, squeeze: bool, escape: bool):
        gap = MARK if escape else " "
        first = gap if prefix else ""
        if squeeze:  # states: before the text, inside it, after spaces inside it
            self.arcs = [{" ": ("", 0), None: (first, 1)}, {" ": ("", 2), None: ("", 1)}, {" ": ("", 2), None: (gap, 1)}]
        else:  # states: at the beginning, then
            self.arcs = [{" ": (first + gap, 1), None: (first, 1)}, {" ": (gap, 1), None: ("", 1)}]
        self.runs = re.compile(" |[^ ]+")
        self.table = None if squeeze else str.maketrans({" ": gap})
        self.first = first

    @classmethod
    def of(cls, model: str) -> Normaliser:
        """From the settings in a model file; ValueError for what is not covered."""
        with open(model, "rb") as f:
            parts = wire(f.read())
        train, norm = wire(parts.get(2, [b""])[-1]), wire(parts.get(3, [b""])[-1])
        flag = lambda fields, k, default: bool(fields.get(k, [default])[-1])
        if flag(norm, 2, b"") or flag(norm, 6, b"") or (5 in parts and flag(wire(parts[5][-1]), 2, b"")):
            raise ValueError("models with a character map are not supported")
        if train.get(3, [1])[-1] not in (1, 2) or flag(train, 24, 0):
            raise ValueError("only unigram and BPE models with white space before words are supported")
        if any(wire(p).get(3, [1])[-1] == 4 for p in parts.get(1, [])):
            raise ValueError("user-defined pieces are not supported")
        return cls(flag(norm, 3, 1), flag(norm, 4, 1), flag(norm, 5, 1))

    def walk(self, text: str) -> str:
        """Composition with the chain of a text, run by run: the characters of a run after the first stay in one state and are copied."""
        out, state = [], 0
        for run in self.runs.findall(text):
            if run in self.arcs[state]:
                put, state = self.arcs[state][run]
                out.append(put)
            else:
                put, state = self.arcs[state][None]
                out.append(put + run)
        return "".join(out)

    def __call__(self, text: str) -> str:
        # After the first character a machine that does not squeeze spaces has one state: a table of characters.
        return self.walk(text) if self.table is None or not text else self.first + text.translate(self.table)


class Machine:
    def __init__(self, model: str):
        import sentencepiece

        self.normal = Normaliser.of(model)
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special and not sp.is_byte(i)}
        self.unk = sp.unk_id()
        with open(model, "rb") as f:
            self.bpe = wire(wire(f.read()).get(2, [b""])[-1]).get(3, [1])[-1] == 2
        # The piece trie: a state is its id (-1 if it is not final) and its arcs by character.
        self.root: dict = {}
        for p, i in self.id.items():
            arcs = self.root
            for c in p[:-1]:
                arcs = arcs.setdefault(c, [-1, {}])[1]
            arcs.setdefault(p[-1], [-1, {}])[0] = i
        joined = {c for p in self.id if len(p) > 1 for c in p}
        self.joined = joined
        self.valid: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        # Surface bytes of each id, for decoding.
        back = {i: b for b, i in self.byte.items()}
        self.surface = [b"" if i in special else bytes([back[i]]) if i in back else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        if self.unk >= 0:
            self.surface[self.unk] = " ⁇ ".encode()
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    @classmethod
    def of(cls, model: str) -> Machine:
        return worker_tables(("pieces", model), lambda: cls(model))

    def merges(self, text: str) -> list[str]:
        """Plain BPE on a short text: the pair of highest score merges first, leftmost of equals. Defines which arcs exist."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.id.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def arc(self, s: int, t: int) -> bool:
        """Whether piece t may follow piece s."""
        key = s * len(self.piece) + t
        got = self.valid.get(key)
        if got is None:
            if len(self.valid) > PAIRS:
                self.valid.clear()
            got = self.valid[key] = self.merges(self.piece[s] + self.piece[t]) == [self.piece[s], self.piece[t]]
        return got

    def compose(self, segment: str) -> list[int]:
        """Best path of a segment in the tropical semiring. For BPE a position is reached with one last piece at most (the machine is
        unambiguous), so states are positions that remember it; for unigrams positions alone are states."""
        n, root, valid, bpe = len(segment), self.root, self.valid.get, self.bpe
        cost, last, back = [float("inf")] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        fallback: dict[int, list[int]] = {}
        pieces = len(self.piece)
        for i in range(n):
            so_far = cost[i]
            if so_far == float("inf"):
                continue
            s, arcs, j = last[i], root, i
            row, weight = s * pieces, so_far + 1.0
            while j < n:
                state = arcs.get(segment[j])
                if state is None:
                    break
                t, arcs = state
                j += 1
                if t < 0:
                    continue
                if not bpe:
                    weight = so_far - self.score[t]
                if weight < cost[j]:
                    if bpe and s >= 0:
                        ok = valid(row + t)
                        if not (self.arc(s, t) if ok is None else ok):
                            continue
                    cost[j], last[j], back[j] = weight, t, i
            if so_far + 1e3 < cost[i + 1] and (segment[i] not in root or root[segment[i]][0] < 0):  # byte fallback: no piece is this character, nothing merges across it
                raw = segment[i].encode("utf-8", "surrogatepass")
                fallback[i + 1] = [self.byte.get(b, self.unk) for b in raw] if self.byte else [self.unk]
                cost[i + 1], last[i + 1], back[i + 1] = so_far + 1e3, -1, i
        out, at = [], n
        while at:
            out.append([last[at]] if last[at] >= 0 else fallback[at])
            at = back[at]
        return [t for e in reversed(out) for t in e]

    def _ids(self, segment: str) -> bytes:
        """A segment's ids as u32 bytes, cut further at characters that no longer piece has."""
        if self.joined.issuperset(segment):
            return array("I", self.compose(segment)).tobytes()
        got: list[int] = []
        run = ""
        for c in segment:
            if c in self.joined:
                run += c
            else:
                if run:
                    got += self.compose(run)
                    run = ""
                got += self.compose(c)
        if run:
            got += self.compose(run)
        return array("I", got).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as native u32 bytes; null and empty give none."""
        if not text:
            return b""
        if self.held > CACHE:
            self.cache, self.older, self.held = {}, self.cache, 0
        cache, older = self.cache, self.older
        out = []
        normal = self.normal(text)
        for line in normal.split("\n"):  # keeps segments short; a line end is a segment of its own
            if out:
                out.append("\n")
            out += self.cut.findall(line) if (MARK + MARK) in line or not line.startswith(MARK) else [MARK + w for w in line[1:].split(MARK)] if len(line) > 1 else [line] if line else []
            if not out:
                out.append("")
        long = {}
        for s in set(out).difference(cache):
            got = older.get(s)
            got = self._ids(s) if got is None else got
            if len(s) > KEEP:
                long[s] = got
            else:
                cache[s] = got
                self.held += 200 + 2 * len(s) + len(got)
        return b"".join([cache[s] if s in cache else long[s] for s in out] if long else map(cache.__getitem__, out))

    def plain(self, text: str) -> str:
        """What a text decodes to: U+2581 as a space, spaces as the normaliser leaves them."""
        return (text if self.normal.table is not None else self.normal(text)[len(self.normal.first) :]).replace(MARK, " ")

    def decode(self, ids) -> str:
        """Text of a sequence of ids; invalid UTF-8 becomes U+FFFD, the dummy prefix goes."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return (raw[1:] if self.normal.first and raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model: str, keep: list[str], with_ids: bool = True) -> DataFrame:
    """``keep`` columns of ``docs`` plus n_pieces, ids_crc32 (of the ids as little-endian u32), round_trip (the decoded text is the text;
    U+2581 decodes as a space, so such texts are compared in that form), and the ids. Null text counts as empty."""
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField

    new = [StructField("n_pieces", LongType()), StructField("ids_crc32", LongType()), StructField("round_trip", BooleanType())]
    if with_ids:
        new.append(StructField("piece_ids", ArrayType(IntegerType())))

    def run(texts):
        m = Machine.of(model)
        got: list[list] = [[] for _ in new]
        for text in texts:
            raw = m.encode(text)
            ids, exact = array("I", raw), np.frombuffer(raw, np.uint32)
            for column, value in zip(got, (len(ids), zlib.crc32(exact.astype("<u4").tobytes()), m.decode(ids) == m.plain(text or ""), exact.view(np.int32)), strict=False):
                column.append(value)
        return got

    return beside(docs, keep, "text", new, run)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, model or model_path(), ["doc_id"], with_ids=False)
