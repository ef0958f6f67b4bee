"""Removal of repeated byte strings with a run-length index.

A byte goes if a string of 100 bytes that covers it also starts earlier (in a smaller doc_id, or before in the same
document). Strings are judged on the input. The corpus is taken apart as prefix-free parsing does before it builds a
run-length Burrows-Wheeler transform of a repetitive text, so that suffixes of distinct contexts only are sorted:

1. Anchors. Of the hashes of all 32-byte strings in a 100-byte window, the least is the window's anchor, wherever the
   window occurs. An anchor's context is all that its windows hold, at most 68 bytes before and after it. Contexts
   that are equal throughout (same anchor hash, same 128-bit digest) are one phrase of the parse: all but the first are
   repeats from end to end. That is found out within each batch before anything is shuffled, so a passage that a third
   of all documents hold sends a row per batch, and then by anchor over all batches.
2. Index. An anchor that stands in several distinct contexts has repeats that end inside them. The contexts, each
   with an end mark of its own, are put together and their Burrows-Wheeler transform is kept as runs: symbol, length,
   where the run's rows go in an LF step, and samples at both ends of the run (the neighbour in suffix order and the
   length in common). Matching statistics are streamed out of the runs alone: all strings step backwards by LF from
   their end marks; inside a run the neighbours step along and the lengths grow by one, at a run's end the sample
   takes over. Positions that match 100 bytes or more are linked to their neighbour; in each group of linked positions
   all but the one that starts earliest in the corpus are marked.
   No index holds more than a bounded number of bytes. Two contexts of an anchor that share a window agree in that
   window's part on the left or on the right of the anchor, so a large group is split exactly by these bytes: windows
   that start low to high bytes before the anchor all hold low bytes on its left and 68 - high on its right. Halving
   the range of low and high splits further, down to single windows. A group that a task can hold is split there; a
   larger one is split by shuffles, and single windows of it are counted like contexts, once a batch.
3. Removal. The marked ranges of a document meet its text, which is cut in one pass.

Memory is bounded for texts of any length: anchors are found piece by piece. Matches are exact up to 128-bit digests
(of contexts, or of windows in the largest groups) beside the 64-bit hash they are grouped by; in the index bytes are
compared. Defined results: null text is empty; rows without doc_id lose nothing and count as no earlier text; ids of
any type that has an order are taken in that order; repeated rows of a doc_id with the same text are the same document;
with other texts they follow each other in the order of their texts; matches never cross documents; texts under 100
bytes stay whole; only the id and the result come back, so names of other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import append, cut, released, small_side, utf8, written

LENGTH, ANCHOR = 100, 32
#: Bytes of contexts in one index: groups are added until there are so many. A group of more bytes is split.
INDEX_BYTES, GROUP_BYTES = 1 << 18, 1 << 18
#: Parts of the distances from a window's start to its anchor by which contexts are trimmed.
QUARTERS = 4
#: Contexts of a group that a task holds; a larger group is split by shuffles.
HOT_CONTEXTS = 100_000
#: Bytes of a text in which anchors are found at once; rows that are gathered before they are handed on.
PIECE, GATHERED = 1 << 18, 1 << 20

U = np.uint64
_rng = np.random.default_rng(20)
_BYTES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def string_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of size (a power of two) bytes, by doubling."""
    out, step, base = values, 1, int(_BASE)
    while step < size:
        out = out[: len(out) - step] * U(base) + out[step:]
        base, step = base * base % 2**64, 2 * step
    return mix(out)


def sliding(values: np.ndarray, size: int, of: Callable) -> np.ndarray:
    """of (minimum or maximum) over each run of size values, by doubling."""
    out, step = values, 1
    while 2 * step <= size:
        out, step = of(out[: len(out) - step], out[step:]), 2 * step
    rest = size - step
    return of(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: bytes, length: int = LENGTH, anchor: int = ANCHOR, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """(positions, hashes, first window starts, last window starts) of a text's anchors, for a piece's windows at a time."""
    raw, wide = np.frombuffer(data, np.uint8), length - anchor
    for start in range(0, len(raw) - length + 1, piece):
        hashes = string_hashes(_BYTES[raw[start : start + piece + length - 1]], anchor)
        least = sliding(hashes, wide + 1, np.minimum)
        # A position is an anchor if some window that holds it has no smaller hash.
        padded = np.concatenate((np.zeros(wide, U), least, np.zeros(wide, U)))
        at = np.flatnonzero(sliding(padded, wide + 1, np.maximum)[: len(hashes)] == hashes)
        # Its windows lie in one run of windows with that least hash, among the runs that it can reach.
        opens = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        closes = np.append(opens[1:], len(least)) - 1
        run, last = (np.searchsorted(opens, x, "right") - 1 for x in (np.maximum(at - wide, 0), at))
        while (other := (least[opens[run]] != hashes[at]) & (run < last)).any():
            run[other] += 1
        yield at + start, hashes[at], np.maximum(opens[run], at - wide) + start, np.minimum(closes[run], at) + start


def digests(strings: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The halves of 128-bit digests."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), U).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ranges in order that neither meet nor overlap."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]


def by_document(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """merged, for each document of its own."""
    if not len(docs):
        return docs, starts, ends
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    number = np.cumsum(np.concatenate(([0], docs[1:] != docs[:-1])))
    step = int(ends.max()) + 1
    a, b = merged(starts + number * step, ends + number * step)
    firsts = np.concatenate(([0], np.flatnonzero(docs[1:] != docs[:-1]) + 1))
    return docs[firsts[a // step]], a % step, b - a // step * step


#: place holds first, size and left (bytes before the anchor) of a context, or, below 0, a range to remove.
ROWS = "key long, one long, two long, doc long, place long"


def placed(first: np.ndarray, size: np.ndarray, left: np.ndarray) -> np.ndarray:
    return first << 32 | size << 16 | left


def found_batch(key, one, two, doc, place) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key, one, two, doc, place)]
    return pa.RecordBatch.from_arrays(columns, ["key", "one", "two", "doc", "place"])


def covers_batch(docs, starts, ends, spread: bool = True) -> pa.RecordBatch:
    """Ranges to remove; for a shuffle by key, one that deals them evenly."""
    docs, starts, ends = by_document(docs, starts, ends)
    none = np.zeros(len(docs), np.int64)
    key = mix(docs.view(U) * U(0xD1342543DE82EF95) + starts.astype(U)) if spread else none
    return found_batch(key, none, none, docs, -1 - (starts << 31 | ends))


def cover_columns(place: str = "place") -> list:
    packed = -1 - F.col(place)
    return [F.shiftright(packed, 31).cast("int").alias("first"), packed.bitwiseAND((1 << 31) - 1).cast("int").alias("last")]


def firsts_only(key: np.ndarray, one: np.ndarray, two: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of the contexts of a batch, the first occurrence of each; later ones as ranges to remove."""
    order = np.lexsort((place, doc, one))
    for _ in range(2):
        k, a, b, d, p = key[order], one[order], two[order], doc[order], place[order]
        same = a[1:] == a[:-1]
        equal = same & (b[1:] == b[:-1]) & (k[1:] == k[:-1])
        if (same == equal).all():
            break
        order = np.lexsort((place, doc, two, one, key))
    new = np.concatenate(([True], ~equal))
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    # In the order of the text again, in which neighbouring rows compress better.
    kept = np.sort(order[new])
    yield found_batch(key[kept], one[kept], two[kept], doc[kept], place[kept])
    # Repeated rows of one document are as early as the first.
    later = (d != d[head]) | (p >> 32 != p[head] >> 32)
    if later.any():
        first = p[later] >> 32
        yield covers_batch(d[later], first, first + (p[later] >> 16 & 0xFFFF))


def parse(length: int, anchor: int) -> Callable:
    """Anchors of documents; within a batch, later occurrences of a context become ranges to remove."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = utf8(text)
                for at, key, starts, ends in anchors(data, length, anchor):
                    ends += length
                    one, two = digests(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
                    yield key, one, two, np.full(len(at), doc, np.int64), placed(starts, ends - starts, at - starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), firsts_only)

    return run


def in_batches(parts: Iterator[tuple], of: Callable) -> Iterator[pa.RecordBatch]:
    """of(columns) for parts put together until they are many."""
    held: list[tuple] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= GATHERED:
            yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)))


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (key, one, two, doc, place): later occurrences become ranges to remove, and the first ones
    of contexts whose anchor has several go on. Between batches only the last first one is held."""
    held = None  # (key, one, two, doc, place) of the last first one, and whether it has gone on
    gone = False
    for batch in batches:
        key, one, two, doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        cover = place < 0
        if cover.any():
            packed = -1 - place[cover]
            yield covers_batch(doc[cover], packed >> 31, packed & (1 << 31) - 1, spread=False)
        mine = ~cover
        if not mine.any():
            continue
        key, one, two, doc, place = (x[mine] for x in (key, one, two, doc, place))
        if held is not None:
            key, one, two, doc, place = (np.concatenate(([h], x)) for h, x in zip(held, (key, one, two, doc, place), strict=True))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        later = (doc != doc[head]) | (place >> 32 != place[head] >> 32)
        if later.any():
            first = place[later] >> 32
            yield covers_batch(doc[later], first, first + (place[later] >> 16 & 0xFFFF), spread=False)
        heads = np.flatnonzero(new)
        k = key[heads]
        several = np.zeros(len(heads), bool)
        several[1:] |= k[1:] == k[:-1]
        several[:-1] |= k[1:] == k[:-1]
        was_gone = gone
        gone = bool(several[-1]) or len(heads) == 1 and was_gone
        if was_gone:
            several[0] = False  # it went on before
        out = heads[several]
        if len(out):
            yield found_batch(key[out], one[out], two[out], doc[out], place[out])
        held = tuple(x[heads[-1]] for x in (key, one, two, doc, place))


class RunIndex:
    """Burrows-Wheeler transform of strings as runs of equal symbols, with samples at both ends of each run."""

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) for s in strings])
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        self.ends = self.starts + sizes
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        self.size = n = len(symbols)
        symbols[self.ends] = 0  # an end mark, below all bytes
        order, levels = suffix_order(symbols)
        before = symbols[order - 1]
        # The first symbol of a string has an end mark before it, which ends its run.
        self.head = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0))))
        self.symbol = before[self.head]
        self.length = np.diff(np.append(self.head, n))
        self.runs = len(self.head)
        # LF: rows of a symbol keep their order.
        by_symbol = np.argsort(self.symbol, kind="stable")
        self.to = np.empty(len(self.head), np.int64)
        self.to[by_symbol] = np.cumsum(self.length[by_symbol]) - self.length[by_symbol]
        # Samples: the neighbour, and the length in common with it, of the rows that a run's two ends go to.
        top, bottom = self.to, self.to + self.length - 1
        self.above, self.common_above = sampled(order, levels, top, -1)
        self.below, self.common_below = sampled(order, levels, bottom, 1)

    def statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text position: its neighbour above in suffix order, the length in common with it, and the one
        with the neighbour below; streamed from the runs, all strings at once, by LF from their end marks."""
        neighbour, up, down = np.full(self.size, -1), np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        # Row i is the end mark of string i; end marks have nothing in common.
        row, at = np.arange(len(self.ends)), self.ends
        above, common_above, common_below = np.roll(self.ends, 1), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        while len(row):
            run = np.searchsorted(self.head, row, "right") - 1
            inside = self.symbol[run] > 0
            row, at, run, above, common_above, common_below = (x[inside] for x in (row, at, run, above, common_above, common_below))
            place = row - self.head[run]
            first, last = place == 0, place == self.length[run] - 1
            above = np.where(first, self.above[run], above - 1)
            common_above = np.where(first, self.common_above[run], common_above + 1)
            common_below = np.where(last, self.common_below[run], common_below + 1)
            row, at = self.to[run] + place, at - 1
            neighbour[at], up[at], down[at] = above, common_above, common_below
        return neighbour, up, down


def sampled(order: np.ndarray, levels: list, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of rows and the lengths in common; no row lies beyond the first and the last."""
    n = len(order)
    there = (rows + step >= 0) & (rows + step < n)
    other = np.where(there, order[np.clip(rows + step, 0, n - 1)], n)
    return np.where(there, other, -1), common_lengths(other, order[rows], levels)


#: Symbols that one sort key holds: 9 bits each.
PACKED = 7


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix order by prefix doubling, and the ranks by the first 7, 14, 28, … symbols on the way.

    An end mark (0) is a symbol of its own, in the order of positions: no two suffixes are equal, and what stands
    behind an end mark never decides.
    """
    n = len(symbols)
    key, open_yet = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate((symbols, np.zeros(PACKED, np.int64)))
    for k in range(PACKED):
        here = np.where(open_yet, padded[k : k + n], 0)
        key = key << 9 | here
        open_yet &= here > 0
    order = np.argsort(key)
    ended = order[~open_yet[order]]
    order[~open_yet[order]] = ended[np.lexsort((ended, key[ended]))]
    key = key[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | ~open_yet[order][1:]))
    step, levels = PACKED, [(1, np.where(symbols > 0, symbols, -1 - np.arange(n)).astype(np.int32))]
    # A rank is the place of the first suffix that is equal so far; only suffixes that share theirs are sorted on.
    rank, place = np.empty(n, np.int64), np.arange(n)
    left, own = order, np.maximum.accumulate(np.where(new, place, 0))
    while True:
        rank[left] = own
        levels.append((step, rank.astype(np.int32)))
        shared = ~(new & np.append(new[1:], True))
        left, own, place = left[shared], own[shared], place[shared]
        if not len(left):
            return order, levels
        # The first symbols of these hold no end mark, so what follows them is inside the text.
        key = own * n + rank[left + step]
        by = np.argsort(key)
        left, key = left[by], key[by]
        order[place] = left
        new = np.concatenate(([True], key[1:] != key[:-1]))
        own, step = np.maximum.accumulate(np.where(new, place, 0)), 2 * step


def common_lengths(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Common lengths of pairs of suffixes, from the ranks of the doubling; a suffix past the end has none."""
    n = len(levels[0][1])
    begun, a, b = a, a.copy(), b.copy()
    for step, rank in reversed(levels):
        ended = np.append(rank, -1 - n)  # past the end: equal to nothing
        for _ in range(PACKED - 1 if step == 1 else 1):
            same = (ended[np.minimum(a, n)] == ended[np.minimum(b, n)]) & (a < n)
            a += step * same
            b += step * same
    return a - begun


def repeats(strings: list[bytes], docs: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (doc, start, end) of the strings' windows that also start earlier in the corpus.

    strings[i] starts at firsts[i] of docs[i].
    """
    index = RunIndex(strings)
    neighbour, up, down = index.statistics()
    n = index.size
    # Positions that are linked, directly or not, hold the same window: root is the one above all of them.
    root = np.where(up >= length, neighbour, np.arange(n))
    while True:
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    part = np.flatnonzero((up >= length) | (down >= length))
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.searchsorted(index.starts, part, side="right") - 1
    doc, start = docs[owner], firsts[owner] + part - index.starts[owner]
    order = np.lexsort((start, doc, root[part]))
    r, d, s = root[part][order], doc[order], start[order]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], r[1:] != r[:-1])), np.arange(len(r)), 0))
    later = (d != d[head]) | (s != s[head])
    return d[later], s[later], s[later] + length


#: A context: doc, where it starts, its bytes, how many of them stand before the anchor.
Context = tuple[int, int, bytes, int]


def core(data: bytes, left: int, low: int, high: int, anchor: int, wide: int) -> bytes | None:
    """What all windows hold that start low to high bytes before the anchor; None if the context has no such window."""
    a, b = left - low, left + anchor + wide - high
    return data[a:b] if a >= 0 and b <= len(data) else None


def trimmed(group: list[Context], anchor: int, wide: int) -> list[Context]:
    """What can match of the contexts of an anchor: those that share the bytes of a quarter of the distances with
    another one, down to the windows of such quarters."""
    ranges: dict[int, tuple[int, int]] = {}
    for i in range(QUARTERS):
        low, high = i * (wide + 1) // QUARTERS, (i + 1) * (wide + 1) // QUARTERS - 1
        cores = [core(g[2], g[3], low, high, anchor, wide) for g in group]
        times = Counter(cores)
        for j, own in enumerate(cores):
            if own is not None and times[own] > 1:
                ranges[j] = (ranges.get(j, (low, 0))[0], high)
    out = []
    for j, (low, high) in sorted(ranges.items()):
        doc, first, data, left = group[j]
        skip = max(0, left - high)
        out.append((doc, first + skip, data[skip : left + anchor + wide - low], left - skip))
    return out


def halves(low: int, high: int) -> tuple[tuple[int, int], ...]:
    middle = (low + high) // 2
    return (low, middle), (middle + 1, high)


def split(group: list[Context], low: int, high: int, anchor: int, wide: int, most: int) -> Iterator[tuple[list[Context], int]]:
    """Groups of at most so many bytes in which all contexts meet that share a window which starts low to high bytes
    before the anchor; and, for a larger group with the same window in all, that window's distance, else -1."""
    if sum(len(g[2]) for g in group) <= most:
        yield group, -1
    elif low == high:
        yield group, low
    else:
        for a, b in halves(low, high):
            parts: dict[bytes, list[Context]] = defaultdict(list)
            for g in group:
                if (own := core(g[2], g[3], a, b, anchor, wide)) is not None:
                    parts[own].append(g)
            for part in parts.values():
                if len(part) > 1:
                    yield from split(part, a, b, anchor, wide, most)


def indexed(length: int, anchor: int, index_bytes: int, group_bytes: int) -> Callable:
    """Contexts in the order of their groups: groups are put together until an index is full."""
    wide = length - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Context] = []
        group: list[Context] = []
        size, now = 0, None

        def close() -> pa.RecordBatch:
            docs, firsts = np.array([g[0] for g in held], np.int64), np.array([g[1] for g in held], np.int64)
            found = repeats([g[2] for g in held], docs, firsts, length)
            held.clear()
            return covers_batch(*found)

        def add() -> Iterator[pa.RecordBatch]:
            nonlocal size
            own = trimmed(group, anchor, wide) if len(group) > 1 else []
            group.clear()
            for part, same in split(own, 0, wide, anchor, wide, group_bytes) if own else ():
                if same >= 0:
                    starts = sorted((g[0], g[1] + g[3] - same) for g in part)
                    docs, firsts = (np.array(x, np.int64) for x in zip(*(x for x in starts[1:] if x != starts[0]), strict=True))
                    yield covers_batch(docs, firsts, firsts + length)
                    continue
                held.extend(part)
                size += sum(len(g[2]) + 1 for g in part)
                if size >= index_bytes:
                    size = 0
                    yield close()

        for batch in batches:
            for key, doc, first, data, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    yield from add()
                now = key
                group.append((doc, first, data, left))
        yield from add()
        if held:
            yield close()

    return run


CONTEXTS = "key long, doc long, first int, data binary, left int"


def halved(length: int, anchor: int) -> Callable:
    """Contexts of large groups, with low and high, once for each half of that range and with the key of its bytes."""
    wide = length - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, first, data, left, low, high in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                for a, b in halves(low, high):
                    if (own := core(data, left, a, b, anchor, wide)) is not None:
                        key = xxhash.xxh3_64_intdigest(own, a << 8 | b)
                        out.append((key - (1 << 63), doc, first, data, left, a, b))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "doc", "first", "data", "left", "low", "high"])

    return run


def single_windows(length: int) -> Callable:
    """The one window that each context is down to, as rows of the parse."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            key, doc, first, left, low = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 4, 5))
            skip = left - low
            one, two = digests(data[a : a + length] for data, a in zip(batch.column(3).to_pylist(), skip.tolist(), strict=True))
            yield key, one.view(np.int64), two.view(np.int64), doc, placed(first + skip, np.full(len(doc), length), low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), firsts_only)

    return run


def together(rows: DataFrame) -> DataFrame:
    """Rows of the parse over all batches: later occurrences as ranges, first ones of keys with several contexts."""
    return written(rows.repartition("key").sortWithinPartitions("key", "one", "two", "doc", "place").mapInArrow(released(gather), ROWS))


def split_large(contexts: DataFrame, large: DataFrame, length: int, anchor: int, held: int) -> tuple[DataFrame, list[DataFrame]]:
    """(contexts in groups of at most held, ranges to remove): the groups named in large are split exactly."""
    wide, ranges = length - anchor, []
    ready = contexts.join(small_side(large, 100_000), "key", "left_anti").select("key", "doc", "first", "data", "left")
    todo = contexts.join(small_side(large, 100_000), "key", "left_semi").withColumns({"low": F.lit(0), "high": F.lit(wide)})
    while True:
        parts = cut(todo.select("key", "doc", "first", "data", "left", "low", "high").mapInArrow(halved(length, anchor), CONTEXTS + ", low int, high int"))
        windows = together(parts.where("low = high").mapInArrow(single_windows(length), ROWS))
        ranges.append(windows.where("place < 0").select("doc", *cover_columns()))
        parts = parts.where("low < high")
        sizes = cut(parts.groupBy("key").count().where("count > 1"))
        large = sizes.where(F.col("count") > held).select("key")
        small = sizes.where(F.col("count") <= held).select("key")
        ready = ready.unionByName(parts.join(small, "key", "left_semi").select("key", "doc", "first", "data", "left"))
        if not large.limit(1).count():
            return ready, ranges
        todo = parts.join(small_side(large, 100_000), "key", "left_semi")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc, text and, if doc is not the id itself, id of the rows with an id; whether a doc may have several rows).

    doc numbers the documents in order. Whole numbers that don't repeat are doc numbers themselves; other ids are
    sorted with their texts.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        if (own.groupBy("id").count().agg(F.max("count")).first()[0] or 1) == 1:
            return own.select(F.col("id").cast("long").alias("doc"), "text"), False
    own = own.withColumn("text", F.coalesce("text", F.lit("")))
    in_order = own.distinct().repartitionByRange(F.col("id"), F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    numbers = cut(in_order.select(F.col("id").alias("n_id"), F.col("text").alias("n_text"), F.monotonically_increasing_id().alias("doc")))
    return own.join(numbers, (F.col("id") == F.col("n_id")) & (F.col("text") == F.col("n_text"))).select("id", "text", "doc"), True


def marked(known: DataFrame, repeated: bool, length: int, anchor: int, index_bytes: int, group_bytes: int, hot_contexts: int) -> DataFrame:
    """Ranges to remove by document: of, ranges."""
    rows = known.select("doc", "text")
    kept = together(rows.mapInArrow(released(parse(length, anchor)), ROWS))

    contexts_of = F.collect_list(F.struct("key", "place")).alias("contexts")
    wanted = kept.where("place >= 0").groupBy("doc").agg(contexts_of).withColumnRenamed("doc", "of")
    once = rows.dropDuplicates(["doc"]) if repeated else rows
    texts = once.join(wanted, F.col("doc") == F.col("of")).select("doc", "text", "contexts")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, contexts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = utf8(text)
                for c in contexts:
                    first, size, left = c["place"] >> 32, c["place"] >> 16 & 0xFFFF, c["place"] & 0xFFFF
                    out.append((c["key"], doc, first, raw[first : first + size], left))
                if len(out) >= 20_000:
                    yield contexts_batch(out)
                    out = []
            if out:
                yield contexts_batch(out)

    contexts = texts.mapInArrow(released(sliced), CONTEXTS)
    covers = kept.where("place < 0").select("doc", *cover_columns())
    large = cut(kept.where("place >= 0").groupBy("key").count().where(F.col("count") > hot_contexts).select("key"))
    if large.limit(1).count():
        contexts, more = split_large(contexts, large, length, anchor, hot_contexts)
        for ranges in more:
            covers = covers.unionByName(ranges)
    indexing = contexts.repartition("key").sortWithinPartitions("key", "doc", "first")
    covers = covers.unionByName(indexing.mapInArrow(released(indexed(length, anchor, index_bytes, group_bytes)), ROWS).select("doc", *cover_columns()))
    return covers.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("ranges")).withColumnRenamed("doc", "of")


def contexts_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "doc", "first", "data", "left"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, index_bytes: int = INDEX_BYTES, group_bytes: int = GROUP_BYTES, hot_contexts: int = HOT_CONTEXTS, keep_bytes: bool = True) -> DataFrame:
    """A row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and, by choice, kept (the remaining bytes)."""
    known, repeated = numbered(docs, id_col, text_col)
    covers = marked(known, repeated, length, anchor, index_bytes, group_bytes, hot_contexts)
    # The same rows, dealt alike, have met their contexts: Spark shuffles them once.
    own_id = F.col("id") if repeated else F.col("doc").cast(docs.schema[id_col].dataType)
    joined = known.join(covers, F.col("doc") == F.col("of"), "left").select(own_id.alias(id_col), "text", "ranges")
    without = docs.where(F.col(id_col).isNull()).select(F.col(id_col), F.col(text_col).alias("text"), F.lit(None).cast("array<struct<first:int,last:int>>").alias("ranges"))

    def make():
        def fn(batch):
            out = [removed(utf8(text), ranges)[: 5 if keep_bytes else 4] for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            return list(zip(*out, strict=True))

        return fn

    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return append(joined.unionByName(without), ddl, make, drop=("text", "ranges"))


def removed(data: bytes, ranges: list[dict] | None) -> tuple[int, int, int, str, bytes]:
    if not ranges:
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), data
    a, b = merged(np.array([r["first"] for r in ranges]), np.array([r["last"] for r in ranges]))
    kept, at = [], 0
    for start, end in zip(a.tolist(), b.tolist(), strict=True):
        kept.append(data[at:start])
        at = end
    kept.append(data[at:])
    rest = b"".join(kept)
    return len(data), len(data) - len(rest), len(a), hashlib.sha256(rest).hexdigest(), rest
