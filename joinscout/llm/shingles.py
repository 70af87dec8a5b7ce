"""Hashed word shingles of many texts at once, by numpy over their bytes.

Words are runs of bytes other than blanks (0x20, 0x09-0x0D), lower-cased in A-Z. A word's hash is a polynomial over random
64-bit byte codes, taken from prefix sums, and then mixed; a shingle's hash is made of its words' hashes.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
GROUP, LONGEST = 1 << 20, 1 << 22  # bytes taken together, and of a text at a time

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; equal values stay equal, others look random."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _need(n: int) -> None:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word."""
    buf = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_BLANK[buf], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = change[::2], change[1::2]
    _need(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODE[buf] * _powers[0][: len(buf)], out=sums[1:], dtype=np.uint64)
    return first, mix((sums[end] - sums[first]) * _powers[1][first])


def _long_words(data: bytes) -> np.ndarray:
    """Hashes of the words of one text, however long; it is cut between words."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + LONGEST)
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        out.append(_words(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        total += mix(words[j : len(words) - n + 1 + j] + _U((j + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))
    return mix(total)


def _set(words: np.ndarray, rolled: np.ndarray | None, n: int) -> np.ndarray:
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < n:
        return _rolled(words, len(words)) + _U(len(words))
    return np.unique(_rolled(words, n) if rolled is None else rolled)


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer than n words are one shingle; no word or null: none."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(data):
        end, size = at, 0
        while end < len(data) and (end == at or size + len(data[end]) < GROUP):
            size += len(data[end]) + 1
            end += 1
        if size > LONGEST:
            out.append(_set(_long_words(data[at]), None, n))
            at += 1
            continue
        first, words = _words(b"\n".join(data[at:end]))
        starts = np.cumsum([0, *(len(x) + 1 for x in data[at:end])])
        cut = np.searchsorted(first, starts).tolist()
        rolled = _rolled(words, n) if len(words) >= n else np.empty(0, np.uint64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            out.append(_set(words[a:b], rolled[a : b - n + 1] if b - a >= n else None, n))
        at = end
    return out
