"""What a document is about: how central its sentences are and which terms are its keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import ranking


def sentence_salience(ranks: DataFrame) -> DataFrame:
    """doc_id, index, score, high, middle: scores with the cuts of the top quarter and the top half."""
    own = Window.partitionBy("doc_id")
    placed = ranks.where("doc_id is not null").withColumn("place", F.row_number().over(own.orderBy(F.desc("score"), "index")) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    cut = lambda fraction: F.max(F.when(F.col("place") == ranking.cut_place(fraction), F.col("score"))).over(own)
    return placed.select(*ranks.columns, cut(0.25).alias("high"), cut(0.5).alias("middle"))


def salient_keys(keywords: DataFrame) -> DataFrame:
    """doc_id and key, without leading articles."""
    return keywords.select("doc_id", X.normalise_key("key").alias("key")).distinct()
