"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of the benchmark items. Per window length there is one table: a block
of the last two words of the scan position says how far the scan may shift; where the shift is 0, the bucket of
that suffix block and of the window's first block holds the patterns, which are compared word by word.

The benchmark is a stated query set. It is read in blocks of bounded bytes; at most so many bytes are shipped to the
tasks at once, with the function that searches them, and a worker holds the tables of one block at a time. Every
document passes through all blocks within one stage, so nothing is shuffled and a lost executor costs only its own
tasks. A benchmark larger than that goes in rounds, between which the rows are kept in the shared folder.

Defined results: null or empty text has no words and no hit; benchmark rows without item_id or words are ignored;
repeated items count once by id; repeated document rows are judged one by one; texts of any length are searched whole;
columns named like a result are replaced by it, all others come back.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import PIECE_ROWS, append, lower_words, utf8, written

WINDOW = 10
#: Bytes of item text in one block of the query set, and in the blocks of one round.
BLOCK_BYTES, ROUND_BYTES = 1 << 20, 64 << 20

Words = list[bytes]


def windows(words: Words, size: int) -> list[tuple[bytes, ...]]:
    """All windows of size words; fewer words are one window, none are none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Search of word patterns that all have the same length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], int]) -> None:
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.skip = m - b + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for pattern, number in patterns.items():
            for j in range(m - b + 1):
                key = self.key(pattern, j)
                self.shift[key] = min(self.shift.get(key, self.skip), m - b - j)
            self.buckets[self.key(pattern, m - b)][self.key(pattern, 0)].append((list(pattern), number))

    def key(self, words, at: int):
        return (words[at], words[at + 1]) if self.block == 2 else words[at]

    def search(self, words: Words) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of each occurrence."""
        m, b, shift, skip, n = self.length, self.block, self.shift, self.skip, len(words)
        at = m - b  # where the scanned block starts
        last = n - b
        get = shift.get
        while at <= last:
            move = get((words[at], words[at + 1]) if b == 2 else words[at], skip)
            if move:
                at += move
                continue
            start = at - m + b
            for pattern, number in self.buckets[self.key(words, at)].get(self.key(words, start), ()):
                if words[start : start + m] == pattern:
                    yield start, number
            at += 1


class Matcher:
    """All windows of some items."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW) -> None:
        numbers: dict[tuple[bytes, ...], int] = {}
        self.items_of: list[set[str]] = []
        for item, text in items:
            for window in windows(lower_words(text), size):
                if (n := numbers.setdefault(window, len(numbers))) == len(self.items_of):
                    self.items_of.append(set())
                self.items_of[n].add(item)
        by_length: dict[int, dict] = defaultdict(dict)
        for window, n in numbers.items():
            by_length[len(window)][window] = n
        self.searches = [WuManber(x) for _, x in sorted(by_length.items())]

    def hits(self, words: Words) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges and the items that occur."""
        spans, items = [], set()
        for search in self.searches:
            for start, number in search.search(words):
                spans.append((start, start + search.length))
                items |= self.items_of[number]
        return spans, items


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded bytes, streamed partition by partition."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row.item, row.text))
        size += len(utf8(row.text))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def union_length(spans: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def rounds(blocks: Iterator[list], size: Callable[[list], int], most: int) -> Iterator[list[list]]:
    """Blocks put together up to most bytes, one at least."""
    held, total = [], 0
    for block in blocks:
        if held and total + size(block) > most:
            yield held
            held, total = [], 0
        held.append(block)
        total += size(block)
    yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES, round_bytes: int = ROUND_BYTES, keep_text: bool = True) -> DataFrame:
    """docs with n_words, hit_spans (word ranges), item_ids (sorted), n_hit, n_items and contaminated."""

    def searching(blocks: list[list[tuple[str, str]]], first: bool) -> Callable:
        def make():
            only = Matcher(blocks[0], size) if len(blocks) == 1 else None

            def fn(batch):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                spans = [[]] * len(texts) if first else batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
                items = [[]] * len(texts) if first else batch.column(batch.schema.get_field_index("item_ids")).to_pylist()
                counts = [0] * len(texts)
                for block in blocks:
                    matcher = only or Matcher(block, size)
                    for i, text in enumerate(texts):
                        words = lower_words(text)
                        counts[i] = len(words)
                        found, these = matcher.hits(words)
                        if found:
                            spans[i] = spans[i] + [{"first": a, "end": b} for a, b in sorted(set(found))]
                            items[i] = sorted(these.union(items[i]))
                return counts, spans, items

            return fn

        return make

    ddl = "n_words long, hit_spans array<struct<first:int,end:int>>, item_ids array<string>"
    out, first = docs, True
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    for held in rounds(blocks, lambda block: sum(len(utf8(text)) for _, text in block), round_bytes):
        out = append(out if first else written(out), ddl, searching(held or [[]], first), piece_rows=PIECE_ROWS if len(held) < 2 else 10_000)
        first = False

    def counted():
        def fn(batch):
            spans = batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
            return ([union_length([(x["first"], x["end"]) for x in s]) for s in spans],)

        return fn

    out = append(out, "n_hit long", counted, drop=() if keep_text else (text_col,))
    return out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def items_digest(column: str = "item_ids"):
    """Lowercase hex of the sorted ids, comma-joined."""
    return F.sha2(F.concat_ws(",", F.col(column)).cast("binary"), 256)
