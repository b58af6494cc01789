"""Vectorised text kernels (numpy) that run inside Arrow batches: code points, rolling hashes, words, word triples.

All hashes are 64 bits: polynomial over the code points modulo 2**64 with an odd base, then mixed. Equal content gives equal
hashes wherever it stands.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(int(BASE), -1, 2**64))
CHUNK_CHARS = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads all input bits over all output bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(30))
        h = h * U(0xBF58476D1CE4E5B9)
        h ^= h >> U(27)
        h = h * U(0x94D049BB133111EB)
        h ^= h >> U(31)
    return h


def id_hash(ids: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(i) for i in ids], U)


_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..n; kept up to the usual chunk size."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n + 1, CHUNK_CHARS // 4)
    with np.errstate(over="ignore"):
        made = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size, b, U))]) for b in (BASE, _BASE_INV)]
    if size <= 4 * CHUNK_CHARS:
        _powers[:] = made
    return made[0], made[1]


class Rolling:
    """Hashes of any ranges of a sequence of numbers."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.power, self.inverse = _power_tables(n)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U)
            np.cumsum((values.astype(U) + U(0x1F3)) * self.power[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of every range of length k."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, U)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: n - k + 1])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after the other, and the offsets of the texts (one more than texts)."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return c, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def text_chunks(texts: list[str], chars: int = CHUNK_CHARS):
    """Ranges (from, to) of texts with about `chars` characters each; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For the basic plane: is it a letter or digit; its form without letter case (one code point)."""
    word, fold = np.zeros(0x10000, bool), np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        s = chr(i)
        word[i] = s.isalnum()
        if word[i]:
            fold[i] = _fold(s)
    return word, fold


def _fold(s: str) -> int:
    f = s.casefold()
    f = f if len(f) == 1 else s.lower()
    return ord(f[0])


def word_chars(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: belongs to a word; its form without letter case."""
    word, fold = _tables()
    if not len(c) or c.max() < 0x10000:
        return word[c], fold[c]
    low = np.minimum(c, 0xFFFF)
    w, f = word[low], fold[low]
    high = np.flatnonzero(c >= 0x10000)
    values, at = np.unique(c[high], return_inverse=True)
    w[high] = np.array([chr(v).isalnum() for v in values])[at]
    f[high] = np.array([_fold(chr(v)) for v in values], np.uint32)[at]
    return w, f


class Words:
    """The words of a chunk of texts: hashes without letter case, and the text each belongs to."""

    def __init__(self, texts: list[str]) -> None:
        c, off = code_points([t + "\n" for t in texts])
        is_word, folded = word_chars(c)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = Rolling(folded).ranges(self.starts, self.ends) if len(self.starts) else np.zeros(0, U)
        self.bounds = np.searchsorted(self.starts, off)  # words of text i: bounds[i] to bounds[i + 1]
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def sequence_digests(self) -> list[bytes]:
        """16 bytes for each text's sequence of words; equal for equal sequences."""
        n, bounds = len(self.hashes), self.bounds
        salted = [Rolling(mix(self.hashes ^ U(s))).ranges(bounds[:-1], bounds[1:]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)] if n else [np.zeros(len(bounds) - 1, U)] * 2
        count = np.diff(bounds).astype(U)
        return [x.tobytes() for x in np.stack([mix(salted[0] + count), salted[1]], 1)]

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the distinct triples of consecutive words of each text, sorted by text, then hash."""
        h, d = self.hashes, self.doc
        if len(h) < 3:
            return np.zeros(0, np.int64), np.zeros(0, U)
        with np.errstate(over="ignore"):
            t = mix(h[:-2] + mix(h[1:-1] + mix(h[2:] ^ U(0xD6E8FEB86659FD93))))
        keep = d[:-2] == d[2:]
        t, d = t[keep], d[:-2][keep]
        o = np.lexsort((t, d))
        t, d = t[o], d[o]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
        return d[new], t[new]


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbouring values, by doubling."""
    m, span = h, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (width - span)], m[width - span :]) if span < width else m


def merge_intervals(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; overlapping and touching ones become one."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return s[new], e[last]
