"""Document frequencies: of a whole table, and as of each document in its order.

Running sums are two-level: rows are dealt by ranges of the order, whose number grows with the rows, counted within each
range, and a small table of counts per range gives what lies before it. No key, not even a word that every document holds, meets in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ._arrow import map_rows


def document_frequency(vocab: DataFrame) -> DataFrame:
    """term and df; a document without terms counts for nothing."""
    return vocab.select("doc_id", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def documents(vocab: DataFrame) -> DataFrame:
    """One row: the number of documents with a vocabulary."""
    return vocab.where(F.size("terms") > 0).agg(F.count(F.lit(1)).alias("documents"))


def smoothed_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def idf(n: Column, df: Column) -> Column:
    """A constant for an empty corpus, blending into the smoothed value over the first documents."""
    few = F.lit(float(L.MIN_DOCUMENTS_FOR_IDF))
    return F.when(n < few, (1.0 - n / few) * L.COLD_START_IDF + n / few * smoothed_idf(n, df)).otherwise(smoothed_idf(n, df))


#: Rows of the order in one range, about.
RANGE_ROWS = 4096


def ranges_of(rows: DataFrame, order: str, ranges: int | None = None, size: int = RANGE_ROWS) -> tuple[float, float]:
    """(start, width) of ranges that cut the order into even parts, more of them for more rows.

    Reads the order alone. Uneven orders give uneven ranges, never wrong sums: the number of a range grows with it.
    """
    low, high, n = rows.agg(F.min(F.col(order).cast("double")), F.max(F.col(order).cast("double")), F.count(F.lit(1))).first()
    if not n or low is None:
        return 0.0, 1.0
    return low, max((high - low) / (ranges or -(-n // size)), 1e-9)


def running_sum(rows: DataFrame, order: str, keys: tuple[str, ...] = (), weight: Column | None = None, name: str = "before", ranges: int | None = None, spans: tuple[float, float] | None = None) -> DataFrame:
    """rows with the sum of weight (1 each) over earlier rows (by order) of the same keys.

    Rows with equal order don't count each other. Order is a number.
    """
    low, width = spans or ranges_of(rows, order, ranges)
    part = F.floor((F.col(order).cast("double") - F.lit(low)) / F.lit(width))
    own = rows.withColumn("range_no", part).withColumn("range_weight", F.lit(1) if weight is None else weight)
    inside = Window.partitionBy(*keys, "range_no").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("inside", F.coalesce(F.sum("range_weight").over(inside), F.lit(0)))
    sums = own.groupBy(*keys, "range_no").agg(F.sum("range_weight").alias("range_sum"))
    earlier = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("range_sum").over(earlier), F.lit(0))).drop("range_sum")
    return own.join(sums, [*keys, "range_no"]).withColumn(name, F.col("inside") + F.col("offset")).drop("range_no", "range_weight", "inside", "offset")


def as_of(vocab: DataFrame, seq: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(doc_id, documents before it), (doc_id, term, df before it): the state that scores a document."""
    ids = list(dict.fromkeys(("doc_id", seq)))
    spans = ranges_of(vocab, seq)
    before = running_sum(vocab.select(*ids, (F.size("terms") > 0).cast("int").alias("one")), seq, weight=F.col("one"), name="documents", spans=spans)
    terms = running_sum(vocab.select(*ids, F.explode("terms").alias("term")), seq, ("term",), name="df", spans=spans)
    return before.select("doc_id", "documents"), terms.select("doc_id", "term", "df")


#: Ranges of asked() with more than UNEVEN times their share of documents are cut anew.
UNEVEN = 8
#: Between words that move as one string, which takes half the bytes of a list.
MARK = "\n"


def ranged(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with range_no, which grows with the order: about size values of the order in each, however they are spread."""
    low, width = ranges_of(rows, order, size=size)
    part = F.floor((F.col(order).cast("double") - F.lit(low)) / F.lit(width))
    own = rows.withColumn("range_no", part)
    if (own.where("range_no is not null").groupBy("range_no").count().agg(F.max("count")).first()[0] or 0) <= UNEVEN * size:
        return own
    places = running_sum(rows.select(order).where(F.col(order).isNotNull()).distinct(), order, name="place", spans=(low, width))
    return rows.join(places.select(order, F.floor(F.col("place") / size).alias("range_no")), order, "left")


def looked_up() -> Callable[..., Iterator[tuple]]:
    """Takes the rows of ranges in order: first what lies before the range, a row a term, then its documents by doc_id."""
    counts: dict[str | None, int] = {}
    fresh: Counter[str | None] = Counter()  # of the rows of the id at hand, which don't count each other
    sought: set[str] = set()
    at = [None, None]

    def run(number, is_document, doc, words, keys, n) -> Iterator[tuple]:
        if number is None:
            yield doc, 0, []
            return
        if at[0] != number:
            counts.clear()
            fresh.clear()
        if at != [number, doc]:
            for term, times in fresh.items():
                counts[term] = counts.get(term, 0) + times
            fresh.clear()
            sought.clear()
        at[:] = number, doc
        if not is_document:
            counts[words] = n
            return
        terms = words.split(MARK) if words else []
        fresh.update(terms)
        fresh[None] += bool(terms)
        sought.update(terms[:n])
        sought.update(keys.split(MARK))
        yield doc, counts[None], [(k, counts[k]) for k in sought if k in fresh and counts.get(k)]

    return run


def asked(rows: DataFrame, frequencies: DataFrame | None = None, documents: int = 0) -> DataFrame:
    """doc_id, documents, known: as as_of, but only of a document's keys that are among its terms, in one row an id.

    rows: doc_id, terms (distinct words), keys (those of several words are no terms). Terms move once, a row a document, to the range of their document; what lies before
    a range is a row for each of its terms. known maps keys to df, without zeros. frequencies (term, df) and documents
    come on top.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    own = ranged(rows.select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.array_distinct(F.filter("keys", lambda k: ~k.contains(" "))).alias("keys")), "doc_id", RANGE_ROWS)
    placed = own.where("range_no is not null")
    sums = placed.select("range_no", F.explode("terms").alias("term")).groupBy("range_no", "term").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.unionByName(placed.groupBy("range_no").agg(F.lit(None).cast("string").alias("term"), F.sum((F.size("terms") > 0).cast("long")).alias("n")))  # documents
    earlier = Window.partitionBy("term").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("n", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    if frequencies is not None:
        sums = sums.join(frequencies.select("term", F.col("df").alias("seen")), "term", "left").withColumn("n", F.col("n") + F.coalesce("seen", F.lit(0)))
    sums = sums.withColumn("n", F.col("n") + F.when(F.col("term").isNull(), documents).otherwise(0)).where("n > 0 or term is null")
    before = sums.select("range_no", F.lit(False).alias("is_document"), F.lit(None).cast(kind).alias("doc_id"), F.col("term").alias("words"), F.lit("").alias("keys"), "n")
    # A document's terms begin with its n keys among them; the other keys may be terms of another row of its id.
    first = own.withColumn("first", F.array_intersect("terms", F.coalesce("keys", F.array().cast("array<string>"))))
    packed = first.select("range_no", F.lit(True).alias("is_document"), "doc_id", F.array_join(F.concat("first", F.array_except("terms", "first")), MARK).alias("words"), F.coalesce(F.array_join(F.array_except("keys", "first"), MARK), F.lit("")).alias("keys"), F.size("first").cast("long").alias("n"))
    dealt = before.unionByName(packed)
    dealt = dealt.repartition("range_no").sortWithinPartitions("range_no", "is_document", "doc_id")
    found = map_rows(dealt, f"doc_id {kind}, documents long, known array<struct<key:string,df:long>>", looked_up, True)
    return found.groupBy("doc_id").agg(F.max("documents").alias("documents"), F.array_distinct(F.flatten(F.collect_list("known"))).alias("known")).select("doc_id", "documents", F.map_from_entries("known").alias("known"))
