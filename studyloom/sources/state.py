"""Corpus state: document frequencies and the number of documents, as versions in a folder.

A version is written whole and then named by a marker, so readers see the old state or the new one. A missing state
is an empty one; a state that can't be read counts as missing. A version may carry the name of the batch that made it:
a batch that is repeated after a crash reads the state before its own version and writes that version again, so no
document counts twice. The last versions are kept, older ones go.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "term string, df long"
_NAME = re.compile(r"v(\d+)(?:-([\w.\-]+))?")


KEPT = 3


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, name of the batch or nothing) of the finished versions, in order."""
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return []
    inside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [(m, s.getPath()) for s in fs.listStatus(folder) if (m := _NAME.fullmatch(s.getPath().getName()))]
    return sorted((int(m[1]), m[2] or "") for m, p in found if fs.exists(inside(p, "_SUCCESS")))


def _place(number: int, batch: str) -> str:
    return f"v{number}-{batch}" if batch else f"v{number}"


def load(spark: SparkSession, path: str, batch: str = "") -> tuple[DataFrame, int]:
    """(term, df) and the number of documents before a batch; the row without a term holds that number."""
    versions = _versions(spark, path)
    own = next((n for n, name in versions if batch and name == batch), None)
    earlier = [v for v in versions if own is None or v[0] < own]
    if earlier:
        try:
            rows = spark.read.schema(SCHEMA).parquet(f"{path}/{_place(*earlier[-1])}")
            total = rows.where("term is null").agg(F.sum("df")).first()[0]
            return rows.where("term is not null"), int(total or 0)
        except AnalysisException:
            pass
    return spark.createDataFrame([], SCHEMA), 0


def save(frequencies: DataFrame, documents: int, path: str, batch: str = "") -> None:
    spark = frequencies.sparkSession
    versions = _versions(spark, path)
    number = next((n for n, name in versions if batch and name == batch), max((n for n, _ in versions), default=0) + 1)
    total = spark.createDataFrame([(None, documents)], SCHEMA)
    frequencies.select("term", F.col("df").cast("long").alias("df")).unionByName(total).write.mode("overwrite").parquet(f"{path}/{_place(number, batch)}")
    _, fs = _folder(spark, path)
    for old in versions:
        if old[0] <= number - KEPT:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{_place(*old)}"), True)


def observe(frequencies: DataFrame, documents: int, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) and (documents) after the documents of vocab; those without terms don't count."""
    fresh = vocab.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    merged = frequencies.unionByName(fresh).groupBy("term").agg(F.sum("df").alias("df"))
    return merged, vocab.where(F.size("terms") > 0).agg((F.count(F.lit(1)) + documents).alias("documents"))
