"""Hashed word and character n-grams, counted per document, and batches of them for numpy training."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Distinct words whose sums a task keeps; beyond that it starts anew, so that memory stays bounded.
CACHE_WORDS = 200_000
#: Longer words give the n-grams of overlapping pieces of this many bytes: nothing is left out, no word is large.
PIECE = 64


def word_pieces(word: bytes) -> list[bytes]:
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word), PIECE)]


def grams(word: bytes, low: int, high: int, buckets: int, whole: bool) -> list[int]:
    """Bucket numbers of a word's n-grams of low to high bytes between ^ and $, and of the whole word."""
    out = [zlib.crc32(word, 1) % buckets] if whole else []
    for piece in word_pieces(word):
        marked = b"^" + piece + b"$"
        for n in range(low, high + 1):
            out += [zlib.crc32(marked[i : i + n]) % buckets for i in range(len(marked) - n + 1)]
    return out


def counted(words: list[bytes], low: int, high: int, buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of a document and how often each occurs."""
    ids, times = [], []
    for word, n in Counter(words).items():
        own = grams(word, low, high, buckets, whole)
        ids += own
        times += [n] * len(own)
    total = np.bincount(np.array(ids, np.int64), times, buckets).astype(np.float32)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found]


def counts_of(table: pa.Table, order: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket numbers, counts) of the rows of an Arrow table's columns ids and counts, in an order; no copies."""
    ids, counts = (table[c].combine_chunks() for c in ("ids", "counts"))
    a, b = ids.values.to_numpy(), counts.values.to_numpy()
    at, to = ids.offsets.to_numpy(), counts.offsets.to_numpy()
    return [(a[at[i] : at[i + 1]], b[to[i] : to[i + 1]]) for i in order]


class WordSums(dict):
    """word -> value, made when first asked for; the caller clears it once it is full."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes):
        value = self[word] = self.make(word)
        return value

    def bounded(self, coming: int = 0) -> WordSums:
        if len(self) + coming > CACHE_WORDS:
            self.clear()
        return self


def minibatches(rows: list[tuple[np.ndarray, np.ndarray]], buckets: int, size: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, dense averaged counts) in random order."""
    order = rng.permutation(len(rows))
    for at in range(0, len(rows), size):
        chosen = order[at : at + size]
        x = np.zeros((len(chosen), buckets), np.float32)
        for i, r in enumerate(chosen):
            ids, n = rows[r]
            if len(ids):
                x[i, ids] = n / n.sum()
        yield chosen, x
