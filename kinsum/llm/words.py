"""Word and shingle hashes of a text, and fixed-size bitmaps of keys."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose hash a worker remembers.
CACHE = 150_000
MULT = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        return self.remember(word, xxhash.xxh3_64_intdigest(word))

    def remember(self, word: bytes, h: int) -> int:
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a text in order: A-Z lower-cased, cut at
        0x20 and 0x09-0x0D (what bytes.split() cuts at)."""
        w = text.lower().split()
        return np.fromiter(map(self.__getitem__, w), np.uint64, len(w))


HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; with fewer words
    the whole sequence is one; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * MULT + words[i : n - k + 1 + i]
    return np.unique(mix(h))


class Bloom:
    """A Bloom bitmap with two places a key (64-bit integers)."""

    def __init__(self, slots: np.ndarray):
        self.bytes = slots.view(np.uint8)
        self.mask = np.int64(len(slots) * 64 - 1)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.int64)
        out = np.ones(len(k), bool)
        for at in (k & self.mask, (k >> np.int64(32)) & self.mask):
            out &= (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def bloom(df: DataFrame, key: Column, bits: int = 26) -> Bloom:
    """Bloom bitmap of the (well-mixed) values of ``key``.  Its size is fixed: at most
    2**(bits - 6) longs reach the driver, however large ``df`` is."""
    mask = F.lit((1 << bits) - 1)
    at = F.explode(F.array(key.bitwiseAND(mask), F.shiftright(key, 32).bitwiseAND(mask)))
    rows = (
        df.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).cast("int").alias("slot"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return Bloom(out)
