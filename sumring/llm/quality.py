"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text: shares of kinds of characters, words and lines, and of hashed words and letter
triples. The weights come from preference pairs, a good against a bad document, by logistic loss on feature differences. The threshold is
the quantile of the training scores that equals the share of bad documents; the published score maps that quantile to ``CUT`` (0.3) on a
logistic scale.

Scale: training reads at most ``MAX_LABELS`` labelled documents (by a hash of the id, a documented sample) and forms ``PAIRS_EACH`` pairs
for each document of the rarer class; scoring is one scan without a shuffle, a text after another.

Edges: null and empty texts have the features of the empty text and a score like any other; very long texts are read whole, in windows;
repeated rows get equal scores, and count each in training; equal scores fall on the same side of the threshold; an empty table gives an
empty result; without labels of both kinds every document is accepted; other columns, whatever their names, pass untouched.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, crc_mod, unused, worker_tables
from .wordhash import LOWER, word_hashes

#: Labelled training documents at most, those of least xxhash64(doc_id).
MAX_LABELS = 20_000
#: Preference pairs for each document of the rarer class; pairs that are worked on at once.
PAIRS_EACH, PAIR_BLOCK = 24, 2_048
#: Ridge penalty per pair, of surface and of hashed features (which are many and each say little); training rounds at most.
L2, L2_HASHED, ROUNDS = 1e-4, 0.05, 25
CUT = 0.3

_BYTES = [b"!", b"|", b"%&$#*", b"?", b".", b",", b"0123456789", b"@", b"<>{}[]\\", b":;/", b"\"'()-_=+~^`"]
_CLASS = np.full(256, len(_BYTES), np.int64)
for _i, _b in enumerate(_BYTES):
    _CLASS[list(_b)] = _i
_CLASS[65:91] = len(_BYTES) + 1  # upper case
_CLASS[97:123] = len(_BYTES) + 2
_CLASS[128:] = len(_BYTES) + 3
_CLASS[[32, 9, 10, 11, 12, 13]] = len(_BYTES) + 4
_JUNK = re.compile(rb"([!%&$#*?|.,_=~-])\1")
#: Buckets of hashed words and of hashed triples of bytes; bytes that are worked on at once.
WORD_BUCKETS, TRIPLE_BUCKETS, WINDOW = 64, 64, 1 << 20
N_FEATURES = len(_BYTES) + 5 + 14 + WORD_BUCKETS + TRIPLE_BUCKETS


def hashed(raw: bytes) -> np.ndarray:
    """Square roots of the shares of hashed words and of hashed triples of bytes, letters in lower case."""
    words, triples = np.zeros(WORD_BUCKETS), np.zeros(TRIPLE_BUCKETS)
    h, _ = word_hashes([raw])
    words += np.bincount((h % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS)
    flat = np.frombuffer(raw, np.uint8)
    for a in range(0, len(flat), WINDOW):
        b = LOWER[flat[a : a + WINDOW + 2]].astype(np.uint32)
        t = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)
        triples += np.bincount(t >> np.uint32(26), minlength=TRIPLE_BUCKETS)
    return np.sqrt(np.concatenate([words / max(1, words.sum()), triples / max(1, triples.sum())]))


def features(text: str | None) -> np.ndarray:
    """Features of a whole text; null and empty give the features of the empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, n = raw.split(), len(raw)
    share = sum((np.bincount(_CLASS[np.frombuffer(raw[a : a + WINDOW], np.uint8)], minlength=len(_BYTES) + 5) for a in range(0, n, WINDOW)), np.zeros(len(_BYTES) + 5)) / max(1, n)
    k = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    junk = len(_JUNK.findall(raw))
    bad = sum(1 for x in lines if x.count(b"|") > 2 or len(_JUNK.findall(x)) > 2)
    upper = sum(map(bytes.isupper, words))
    lower = {w.lower() for w in words}
    return np.concatenate([np.sqrt(share), [
        np.log1p(n), np.log1p(len(words)), (n - len(words)) / k / 10, np.sqrt(junk / k), np.sqrt(words.count(b"|") / k), np.sqrt(upper / k), len(lower) / k,
        len(set(lines)) / m, np.sqrt(bad / m), np.log1p(m), np.log1p(n / m), sum(len(w) > 20 for w in words) / k, float(len(words) < 20), float(not words)], hashed(raw)])


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7) -> dict:
    """Weights, centre and scale, cut and slope. Without both classes all weights are 0 and every document is accepted."""
    mean, std = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    z, w = (x - mean) / std, np.zeros(x.shape[1])
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return {"mean": mean, "std": std, "w": np.zeros(N_FEATURES), "cut": 0.0, "slope": 1.0}
    rng = np.random.default_rng(seed)
    n = PAIRS_EACH * min(len(a), len(b))
    ridge = np.full(len(w), L2)
    ridge[-WORD_BUCKETS - TRIPLE_BUCKETS :] = L2_HASHED
    better, worse = rng.permutation(np.resize(a, n)), np.resize(b, n)
    for _ in range(ROUNDS):  # Newton steps on sum(log(1 + exp(-d.w))) / n + ridge * w^2 / 2
        grad, hess = -ridge * w, np.diag(ridge)
        for at in range(0, n, PAIR_BLOCK):
            d = z[better[at : at + PAIR_BLOCK]] - z[worse[at : at + PAIR_BLOCK]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad, hess = grad + d.T @ p / n, hess + (d.T * (p * (1 - p))) @ d / n
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    s = z @ w
    cut = float(np.quantile(s, len(b) / len(s)))
    lo, hi = np.quantile(s, [0.02, 0.98])
    return {"mean": mean, "std": std, "w": w, "cut": cut, "slope": float(8 / max(hi - lo, 1e-6))}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    s = ((x - model["mean"]) / model["std"]) @ model["w"] - model["cut"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * s + np.log(CUT / (1 - CUT)), -30, 30)))


def _featured(docs: DataFrame) -> DataFrame:
    from pyspark.sql.types import ArrayType, DoubleType, StructField

    def run(texts):
        worker_tables()
        return [[features(t) for t in texts]]

    return beside(docs, [c for c in docs.columns if c != "text"], "text", [StructField("x", ArrayType(DoubleType()))], run)


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> dict:
    """Learn from labelled documents (``labels``: doc_id, quality) whose crc32(doc_id) mod 5 is not 0. Null labels and ids are left out;
    a document labelled twice counts twice."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labels)  # bounded: it may be broadcast
    got = _featured(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")).select("quality", "x").toArrow()
    x, good = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES), got["quality"].to_numpy() == 1
    del got
    order = np.lexsort([*x.T, good]) if len(x) else np.zeros(0, int)
    return fit(x[order], good[order])


def scored(docs: DataFrame, model: dict, out: str = "quality_score") -> DataFrame:
    """``docs`` with the score of its ``text`` in ``out`` (replaced if there)."""
    from pyspark.sql.types import DoubleType, StructField

    def run(texts):
        worker_tables()
        return [score(model, np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES))]

    return beside(docs, docs.columns, "text", [StructField(out, DoubleType())], run)


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    name = unused(docs, "quality_score")
    return scored(docs, model, name).where(F.col(name) >= CUT).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model, "score")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
