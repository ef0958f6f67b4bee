"""Limits on the rows of a document: one number for all, or a table with a number for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A number, or a table of doc_id (once each) and most; documents that it lacks keep nothing.
Limit = int | DataFrame


def with_most(rows: DataFrame, limit: Limit) -> DataFrame:
    """rows with their document's limit as the column most."""
    return rows.join(limit, "doc_id") if isinstance(limit, DataFrame) else rows.withColumn("most", F.lit(limit))


def within(rows: DataFrame, limit: Limit, place: str = "place") -> DataFrame:
    """The rows whose place, from 1, is within the limit; a limit under 1 keeps none."""
    return with_most(rows, limit).where(F.col(place) <= F.col("most")).drop("most")
