"""Sentence ranking: by word frequency for short documents, by a similarity graph for the others.

The sentence table has doc_id, index, sentence and words (content lemmas with repeats). Rank tables have doc_id,
index and score; ties are settled by index wherever an order matters.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ._arrow import map_rows
from .limits import Limit, within


def frequency_rank(sents: DataFrame) -> DataFrame:
    """Mean share of the most frequent word's count, scaled by length and position."""
    doc = Window.partitionBy("doc_id")
    rows = sents.select("doc_id", "index", F.explode_outer("words").alias("word"))
    rows = rows.withColumn("freq", F.when(F.col("word").isNotNull(), F.count("word").over(Window.partitionBy("doc_id", "word"))))
    own = rows.groupBy("doc_id", "index").agg(F.sum("freq").alias("sum"), F.count("word").alias("n"), F.max("freq").alias("most"))
    own = own.withColumn("peak", F.max("most").over(doc)).withColumn("total", F.count(F.lit(1)).over(doc))
    score = F.col("sum") / F.col("peak") / F.col("n") * F.least(F.col("n"), F.lit(30)) / 30 * (1.0 + 0.1 * (1.0 - F.col("index") / F.col("total")))
    return own.select("doc_id", "index", F.coalesce(score, F.lit(0.0)).alias("score"))


def rounded(score: Column, digits: int) -> Column:
    """A score, 0 or more, to so many digits in binary arithmetic; F.round goes by the decimal form instead, and the two
    differ on scores like 203 / 3200 that lie between two results."""
    return F.floor(score * float(10**digits) + 0.5) / float(10**digits)


def similarity(shared: Column, left: Column, right: Column) -> Column:
    """Words in common over the logarithms of both sizes."""
    return F.when((left > 0) & (right > 0) & (shared > 0), shared / (F.log(left + 1.0) + F.log(right + 1.0))).otherwise(F.lit(0.0))


def similarity_edges(sents: DataFrame) -> DataFrame:
    """doc_id, i, j (i < j) and weight of sentences of one document that share a word: an equi-join on the word."""
    own = sents.select("doc_id", "index", F.array_distinct("words").alias("words"))
    rows = own.select("doc_id", "index", F.size("words").alias("n"), F.explode("words").alias("word"))
    a, b = (rows.select("doc_id", "word", F.col("index").alias(i), F.col("n").alias(n)) for i, n in (("i", "ni"), ("j", "nj")))
    pairs = a.join(b, ["doc_id", "word"]).where("i < j").groupBy("doc_id", "i", "j", "ni", "nj").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.select("doc_id", "i", "j", similarity(F.col("shared"), F.col("ni"), F.col("nj")).alias("weight"))


def pagerank(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores of n sentences of an undirected weighted graph; each edge is given once."""
    if n <= 1:
        return np.ones(n)
    source, target, w = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((weight, weight))
    out = np.bincount(source, w, n)
    dangling = out == 0
    share = w / np.where(dangling, 1, out)[source]
    scores = np.full(n, 1 / n)
    for _ in range(L.MAX_ITERATIONS):
        spread = np.bincount(target, share * scores[source], n) + scores[dangling].sum() / n
        fresh = (1 - L.DAMPING) / n + L.DAMPING * spread
        moved = np.abs(fresh - scores).max()
        scores = fresh
        if moved < L.TOLERANCE:
            break
    return scores / scores.sum()


def document_edges(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The similarity edges of one document, from an index of its words."""
    holders: dict[str, list[int]] = defaultdict(list)
    sets = [set(w) for w in words]
    for k, own in enumerate(sets):
        for word in own:
            holders[word].append(k)
    sizes = np.array([math.log(len(s) + 1) for s in sets])
    i, j, w = [], [], []
    for k, own in enumerate(sets):
        shared = np.zeros(len(sets), np.int64)
        for word in own:
            shared[holders[word]] += 1
        later = np.flatnonzero(shared[k + 1 :]) + k + 1
        i.append(np.full(len(later), k))
        j.append(later)
        w.append(shared[later] / (sizes[k] + sizes[later]))
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (i, j, w))


def textrank(sents: DataFrame) -> DataFrame:
    """PageRank over each document's similarity graph; a document's sentences come together, no more."""
    docs = sents.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", "words"))).alias("own"))

    def ranked(doc, own) -> Iterator[tuple]:
        scores = pagerank(len(own), *(x.astype(t) for x, t in zip(document_edges([s["words"] for s in own]), (np.int64, np.int64, float), strict=True)))
        for s, score in zip(own, scores.tolist(), strict=True):
            yield doc, s["index"], score

    kind = sents.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, f"doc_id {kind}, index int, score double", ranked)


def rank_sentences(sents: DataFrame, graph_min: int = L.GRAPH_MIN_SENTENCES) -> DataFrame:
    """Each document by the method that suits its number of sentences."""
    sized = sents.withColumn("n_sents", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return frequency_rank(sized.where(F.col("n_sents") < graph_min)).unionByName(textrank(sized.where(F.col("n_sents") >= graph_min)))


def cut_place(fraction: float) -> Column:
    """The place, from 0, of the last sentence of about the top fraction of n."""
    return F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(fraction)).cast("int") - 1))


def sentence_cut(ranks: DataFrame, fraction: float) -> DataFrame:
    """doc_id and cut: the score that separates about the top fraction of a document's sentences."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "index")
    own = ranks.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return own.where(F.col("place") == cut_place(fraction)).select("doc_id", F.col("score").alias("cut"))


def summarise(sents: DataFrame, ranks: DataFrame, most: Limit = 5) -> DataFrame:
    """The top sentences of each document, to be read in the order of index."""
    from ..functions import text as X

    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "index")
    best = within(ranks.withColumn("place", F.row_number().over(order)), most)
    return best.join(sents.select("doc_id", "index", "sentence"), ["doc_id", "index"]).select("doc_id", "index", X.collapse(X.strip_list_marker("sentence")).alias("text"), rounded(F.col("score"), 6).alias("score"))
