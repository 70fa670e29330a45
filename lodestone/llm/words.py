"""Vectorised words and shingles of whole texts.

A word is a maximal run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. Every byte of a
multi-byte UTF-8 character is 0x80 or more, so the rule holds byte by byte and numpy finds all words of a
chunk of texts at once. Words and shingles are 64-bit hashes; callers that need exactness compare the bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("0") : ord("9") + 1] = _IS_WORD[ord("a") : ord("z") + 1] = _IS_WORD[0x80:] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of a chunk of texts: lower-cased bytes, each word's byte span and hash, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.count())

    def bytes_of(self, i: int, n: int = 1) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n], strict=True)]


def words(texts: pa.LargeBinaryArray) -> Words:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    data = _LOWER[data]
    inside = _IS_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, h, np.searchsorted(start, bounds))


def shingles(w: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one text. short: a text of fewer words, but not none, has one shingle of all its words, at its first word."""
    n = len(w.hash)
    h = np.zeros(n, np.uint64)
    valid = np.zeros(n, bool)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc = mix(acc * np.uint64(_BASE) + w.hash[j : n - k + 1 + j])
        h[: n - k + 1] = acc
    count = w.count()
    left = np.repeat(w.first[1:], count) - np.arange(n)
    valid = left >= k
    if short:
        for t in np.flatnonzero((count > 0) & (count < k)):
            i, acc = w.first[t], np.zeros(1, np.uint64)
            for j in range(count[t]):
                acc = mix(acc * np.uint64(_BASE) + w.hash[i + j : i + j + 1])
            h[i], valid[i] = acc[0], True
    return h, valid
