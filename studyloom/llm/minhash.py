"""N-gram Jaccard join by MinHash banding.

Band and row counts are chosen for a target recall at the threshold; documents meet by shuffling band hashes; every
pair that meets is verified on the full n-gram sets. Nothing ever holds all pairs of a group:

1. Documents with equal n-gram sets are one class; a class is counted, not expanded.
2. Band hashes of classes are shuffled; only buckets with two classes or more go on. A bucket is dealt in blocks by
   hash, and tasks compare one block with itself or another. Sizes are partial sums that are joined back, which lets
   Spark split a skewed bucket: no bucket lands whole in one task.
3. A pair that shares several bands is verified in the first of them only. The first pass, on band hashes alone,
   finds out which classes of a bucket have such a pair; only these fetch their n-gram sets for the second pass.
4. The second pass yields, per class, the number of documents it links to there and the least class it is connected
   with there: sums and star edges, never the pairs. Components come from repeated least-label steps over the edges,
   each kept in the shared folder.

N-grams are of lower-cased words; fewer words than an n-gram are one n-gram; documents without words link to none.

Defined results: a null or empty text is a class of its own without links; rows that repeat a doc_id with an equal
set count as copies; a row with null doc_id comes back with its own null class and no links; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import append, cut, lower_words, released, unused

NGRAM, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.99999, 96
#: Classes of a bucket that meet in one task.
BLOCK = 256
#: Distinct words whose hashes a worker keeps; n-grams hashed at once.
CACHE, CHUNK = 200_000, 200_000
MAX_ROUNDS = 60

U = np.uint64
_SEED = 0x5EED


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false meetings, with which max_hashes reach the recall."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        meets = threshold**rows
        bands = np.ceil(np.log(1 - recall) / np.log1p(-meets)) if meets < 1 else 1
        if bands * rows <= max_hashes:
            best = (max(1, int(bands)), rows)
    return best


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, _SEED)
        return value


_words = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def ngrams(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, U)
    own = np.fromiter(map(_words.__getitem__, words), U, len(words))
    size = min(n, len(words))
    sums = np.full(len(words) - size + 1, size, U)
    for i in range(size):
        sums = sums * U(0x9E3779B97F4A7C15) + own[i : len(own) - size + 1 + i]
    return np.unique(mix(sums))


class Signer:
    """Band hashes of n-gram sets, many sets at once."""

    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * U(2) + U(1)
        self.terms = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, bands) hashes; sets are not empty."""
        out = np.empty((len(sets), self.bands), U)
        at = 0
        while at < len(sets):
            end, total = at + 1, len(sets[at])
            while end < len(sets) and total + len(sets[end]) <= CHUNK:
                total += len(sets[end])
                end += 1
            values = np.concatenate(sets[at:end])
            starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : end - 1]]))).astype(np.int64)
            for band in range(self.bands):
                key = np.full(end - at, band, U)
                for row in range(self.rows):
                    i = band * self.rows + row
                    key = mix(key * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(values * self.factors[i] + self.terms[i], starts))
                out[at:end, band] = key
            at = end
        return out


def signatures(docs: DataFrame, bands: int, rows: int, n: int, text_col: str) -> DataFrame:
    """docs without text, with set_key (16 bytes, null without n-grams) and bands (an array of longs)."""

    def make():
        signer = Signer(bands, rows)

        def fn(batch):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            keys, out = [None] * len(texts), [None] * len(texts)
            held: list[np.ndarray] = []
            where: list[int] = []
            size = 0

            def flush() -> None:
                for i, row in zip(where, signer.sign(held).view(np.int64).tolist() if held else (), strict=True):
                    out[i] = row
                held.clear()
                where.clear()

            for i, text in enumerate(texts):
                own = ngrams(text, n)
                if len(own):
                    keys[i] = xxhash.xxh3_128_digest(own.tobytes())
                    held.append(own)
                    where.append(i)
                    size += len(own)
                if size >= CHUNK:
                    flush()
                    size = 0
            flush()
            return keys, out

        fn.close = _words.clear
        return fn

    return append(docs, "set_key binary, bands array<long>", make, drop=(text_col,))


def block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """rows (set_key, bucket, n, …) once for each pair of blocks that their block is part of, with lo and hi."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("set_key"), blocks).cast("int")
    return rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other", "n")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns of each run of rows with equal first columns, across batches."""
    held: list[list] = []
    now = None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # a whole batch of sets as Python values would weigh twice
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if row[:keys] != now:
                    if held:
                        yield held
                    held, now = [], row[:keys]
                held.append(row)
    if held:
        yield held


def first_meetings(bands: np.ndarray, band: int, mine: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Pairs (i, j), i < j, of a block pair whose first common band is this one."""
    n = len(bands)
    same = np.zeros((n, n), bool)
    for b in range(band):
        same |= bands[:, b][:, None] == bands[:, b][None, :]
    own = ~same
    own &= np.triu(np.ones((n, n), bool), 1)
    if lo != hi:
        own &= mine[:, None] != mine[None, :]
    return np.argwhere(own)


def overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(pairs) <= 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    # Many pairs of few sets: products of membership matrices, a slice of the values at a time.
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    distinct, column = np.unique(values, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, len(distinct), 8192):
        a, b = np.searchsorted(column, (at, at + 8192))
        part = np.zeros((len(sets), min(8192, len(distinct) - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += part @ part.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def roots(n: int, pairs: np.ndarray) -> list[int]:
    """The least member of each member's component; members are in order."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of the edges (a, b). Labels fall until none does."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(MAX_ROUNDS):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("via"))
        moved = cut(stepped.join(jump, F.col("to") == F.col("at"), "left").select("node", F.least("to", "via").alias("label"), "was"))
        labels = moved.select("node", "label")
        if not moved.where("label != was").limit(1).count():
            return labels
    raise RuntimeError("labels did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """A row per row of docs: its id, class_id (least id of the documents it is linked with, directly or not) and n_links.

    n_links counts the other documents with a similarity of threshold or more.
    """
    bands, rows = bands_for(threshold, recall)
    kind = docs.schema[id_col].dataType
    ids = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    signed = cut(signatures(ids, bands, rows, n, "text"))
    classes = cut(signed.where("doc is not null and set_key is not null").groupBy("set_key").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")))

    # Buckets with two classes or more, each in blocks by hash; sizes are counted with partial aggregation.
    met = classes.select("set_key", F.posexplode("bands").alias("band", "bucket"))
    sizes = met.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    candidates = cut(block_pairs(met.join(sizes, ["band", "bucket"]), block).join(classes.select("set_key", "head", "copies", "bands"), "set_key"))

    # First pass, on band hashes: who has a pair whose first common band is this bucket's?
    order = ["band", "bucket", "lo", "hi"]
    first = candidates.select(*order, "set_key", "mine", "bands").repartition("band", "bucket", "lo", "hi").sortWithinPartitions(*order, "set_key")

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in grouped(batches, 4):
            if len(group) > 1:
                band, bucket_no, lo, hi = group[0][:4]
                hashes, mine = np.array([g[6] for g in group]), np.array([g[5] for g in group])
                found = np.unique(first_meetings(hashes, band, mine, lo, hi))
                out += [(band, bucket_no, lo, hi, group[i][4], group[i][5]) for i in found.tolist()]
            if len(out) >= 5000:
                yield meeting_batch(out)
                out = []
        if out:
            yield meeting_batch(out)

    live = cut(first.mapInArrow(released(meeting), "band int, bucket long, lo int, hi int, set_key binary, mine int"))

    # Second pass: the texts of one document of each such class, their sets, verification.
    wanted = live.groupBy("set_key").agg(F.collect_list(F.struct("band", "bucket", "lo", "hi", "mine")).alias("places")).join(classes.select("set_key", "head", "copies"), "set_key")
    texts = ids.join(wanted, F.col("doc") == F.col("head")).select("text", "set_key", "copies", "places")

    def with_sets():
        signer = Signer(bands, rows)

        def fn(batch):
            own = [ngrams(x, n) for x in batch.column(0).to_pylist()]
            keys = batch.column(1).to_pylist()
            # A doc_id that has several texts brings them all; the one that made the set goes on.
            right = [xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(own, keys, strict=True)]
            own = [s if r else s[:0] for s, r in zip(own, right, strict=True)]
            signs = iter(signer.sign([s for s in own if len(s)]).view(np.int64).tolist() if any(right) else ())
            return [s.tobytes() if r else None for s, r in zip(own, right, strict=True)], [next(signs) if r else None for r in right]

        fn.close = _words.clear
        return fn

    sets = append(texts, "grams binary, bands array<long>", with_sets, drop=("text",)).where("grams is not null")
    placed = sets.select(F.explode("places").alias("p"), "set_key", "copies", "bands", "grams").select("p.band", "p.bucket", "p.lo", "p.hi", "set_key", "p.mine", "copies", "bands", "grams")
    second = placed.repartition("band", "bucket", "lo", "hi").sortWithinPartitions(*order, "set_key")

    def verifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in grouped(batches, 4):
            group = [g for i, g in enumerate(group) if not i or g[4] != group[i - 1][4] or g[5] != group[i - 1][5]]
            if len(group) > 1:
                band, _, lo, hi = group[0][:4]
                pairs = first_meetings(np.array([g[7] for g in group]), band, np.array([g[5] for g in group]), lo, hi)
                grams = [np.frombuffer(g[8], U) for g in group]
                if len(pairs):
                    sizes, shared = np.array([len(s) for s in grams]), overlaps(grams, pairs)
                    union = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - shared
                    pairs = pairs[shared >= threshold * union]
                links = np.zeros(len(group), np.int64)
                copies = np.array([g[6] for g in group])
                np.add.at(links, pairs[:, 0], copies[pairs[:, 1]])
                np.add.at(links, pairs[:, 1], copies[pairs[:, 0]])
                least = roots(len(group), pairs)
                out += [(g[4], group[r][4], int(k)) for g, r, k in zip(group, least, links, strict=True) if k]
            if len(out) >= 5000:
                yield verified_batch(out)
                out = []
        if out:
            yield verified_batch(out)

    verified = cut(second.mapInArrow(released(verifying), "set_key binary, root binary, links long"))
    labels = components(verified.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    sums = verified.groupBy("set_key").agg(F.sum("links").alias("links"))

    # The least id of a component; classes without links are their own.
    known = classes.select("set_key", "head", "copies").join(labels, F.col("set_key") == F.col("node"), "left").join(sums, "set_key", "left").withColumn("part", F.coalesce("label", "set_key"))
    least = known.where("label is not null").groupBy("part").agg(F.min("head").alias("least"))
    named = known.join(least, "part", "left").select(F.col("set_key").alias("key"), F.coalesce("least", "head").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return (
        signed.select("doc", "set_key")
        .join(named, (F.col("set_key") == F.col("key")) & F.col("doc").isNotNull(), "left")
        .select(F.col("doc").alias(id_col), F.coalesce("class", "doc").cast(kind).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    )


def meeting_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["band", "bucket", "lo", "hi", "set_key", "mine"])


def verified_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["set_key", "root", "links"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs of which one of each group of near-duplicates stays: the one with the least id (rows that repeat it stay too)."""
    found = near_duplicates(docs, id_col, text_col)
    # A left anti join gives back the left side only; its condition names the sides, so no column can clash.
    gone = cut(found.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias(unused("gone", docs.columns))).distinct())
    return docs.join(gone, F.col(id_col) == F.col(gone.columns[0]), "left_anti")
