"""The lexicon of relations between terms, as a table that may be absent."""

from __future__ import annotations

import warnings

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "term string, relation string, other string"
KINDS = ("same", "antonym", "wider")


def load(spark: SparkSession, path: str | None) -> DataFrame:
    """(term, relation, other) of a Parquet table; without a path, or where it can't be read or lacks a column, an
    empty table and a warning.

    Distractors do without it: they come from the document alone and no synonym is kept out. Rows with a null or of an
    unknown relation are left out, repeated rows count once, further columns are ignored.
    """
    names = ["term", "relation", "other"]
    if path:
        try:
            rows = spark.read.parquet(path).select(*(F.col(n).cast("string").alias(n) for n in names))
            return rows.dropna().where(F.col("relation").isin(*KINDS)).distinct()
        except PySparkException as error:
            warnings.warn(f"no lexicon at {path} ({error.getCondition()}): distractors come from the document alone", stacklevel=2)
    return spark.createDataFrame([], SCHEMA)
