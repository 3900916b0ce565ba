"""Vectorised 64-bit hashes of the words of many texts: one NumPy pass over the joined UTF-8 bytes, no Python loop over words.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D`` after lower-casing A-Z. Its hash is a polynomial over its bytes modulo
2**64, finished by a mixing step. Two different words share a hash with odds of about 1e-19 a pair.
"""

from __future__ import annotations

import re

import numpy as np

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        _powers[name] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    flat = LOWER[flat]
    inner = ~_SPACE[flat]
    edge = np.diff(inner.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last byte is a line end
    if len(end) < len(begin):
        end = np.append(end, len(flat))
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _power(_R, len(flat), "r"), out=total[1:])
    h = (total[end] - total[begin]) * _power(_RINV, len(flat), "inv")[begin]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mix(h), np.diff(np.searchsorted(begin, ends), prepend=0)


def _pieces(text: bytes, most: int):
    """Cut a text after white space, into pieces of about ``most`` bytes (more only where one word is longer)."""
    at = 0
    while len(text) - at > most:
        gap = _GAP.search(text, at + most)
        if gap is None:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:]


def word_hashes(texts: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text). Works on about ``most`` bytes at a time, long texts in pieces."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        for p in (t,) if len(t) <= most else _pieces(t, most):
            pieces.append(p)
            owner.append(i)
    got = [_hashes(pieces[a:b]) for a, b in blocks(pieces, most)]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(owner, np.concatenate([c for _, c in got]), len(texts)).astype(np.int64)
    return np.concatenate([h for h, _ in got]), counts


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles of one text; of fewer words (at least one), of the whole sequence."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(_R) + words[i : n - k + 1 + i])
    return out


def blocks(texts, most: int):
    """Slices of a list of byte strings that hold about ``most`` bytes each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
