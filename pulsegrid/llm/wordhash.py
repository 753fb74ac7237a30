"""Vectorised word and window hashes over batches of texts.

A batch's UTF-8 bytes are hashed through prefix sums modulo 2**64: with
P[i] the sum of tab[byte] * B**i, the hash of bytes [s, e) is
(P[e] - P[s]) * B**-s, then mixed with the length. Windows of words use the
same sums over word hashes. All arithmetic wraps, so hashes don't depend on
where a word stands or on the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TAB = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n at least, kept for the next batch."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        n = max(n, 1 << 16)
        inv = np.uint64(pow(key, -1, 1 << 64))
        both = []
        for b in (base, inv):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[key] = tuple(both)
    return _powers[key]


class Words:
    """Words of a batch of texts: ``start``/``end`` byte places, ``first[d]`` the index of text d's first word, ``h`` their hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, between: np.ndarray = _WS):
        """``data``: uint8 bytes; ``bounds``: len(texts) + 1 byte places; ``between``: which of the 256 bytes stand between words."""
        self.data, self.bounds = data, bounds
        if lower:
            data = _LOWER[data]
        n = len(data)
        word = ~between[data] if n else np.zeros(0, bool)
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < n)]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        up, down = _pow(_B, n + 1)
        p = np.zeros(n + 1, np.uint64)
        np.cumsum(_TAB[data] * up[:n], out=p[1:])
        h = (p[self.end] - p[self.start]) * down[self.start]
        self.h = mix64(h ^ (self.end - self.start).astype(np.uint64) * _C)

    def windows(self, length: int, seed: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each word on; those that leave their text mean nothing (see ``fits``)."""
        m = len(self.h)
        out = np.zeros(m, np.uint64)
        if m < length:
            return out
        up, down = _pow(_C, m + 1)
        h = mix64(self.h + np.uint64(seed)) if seed else self.h
        q = np.zeros(m + 1, np.uint64)
        np.cumsum(h * up[:m], out=q[1:])
        k = m - length + 1
        out[:k] = mix64((q[length:] - q[:k]) * down[:k] + np.uint64(length))
        return out

    def fits(self, length: int) -> np.ndarray:
        """Whether the window of ``length`` words from each word on stays in its text."""
        last = self.first[1:][self.text_of] if len(self.h) else np.zeros(0, np.int64)
        return np.arange(len(self.h)) + length <= last


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, (bounds - bounds[0]).astype(np.int64)


def hash_words(texts: pa.Array, lower: bool = False, between: np.ndarray = _WS) -> Words:
    return Words(*buffers(texts), lower, between)


def slices(texts: pa.Array, limit: int):
    """(first, stop) ranges of an Arrow string array of about ``limit`` bytes, a text at least."""
    sizes = np.diff(buffers(texts)[1])
    group = (np.cumsum(sizes) - sizes) // max(1, limit) if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of a sequence of 64-bit values; they depend on the values alone."""
    n = len(values)
    up, down = _pow(_B, n + 1)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=p[1:])
    return mix64((p[end] - p[start]) * down[start] ^ (end - start).astype(np.uint64) * _C)


def window_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """argmin of ``h`` over [i, i + width) for each i with a whole window; the leftmost of ties."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = h.copy(), np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        other, where = best[step:], at[step:]
        m = len(other)
        take = other < best[:m]
        best, at = np.where(take, other, best[:m]), np.where(take, where, at[:m])
        have += step
    return at[:n]
