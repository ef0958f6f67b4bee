"""Lines of a document that look like headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def headings(docs: DataFrame, text_col: str = "text", limit: int = 12) -> DataFrame:
    """doc_id, pos, heading: the first limit headings. A # marks one; else words in upper case do."""
    lines = F.split(X.normalise(text_col), "\n")
    rows = docs.select("doc_id", F.posexplode(lines).alias("line_no", "line")).withColumn("line", X.strip("line"))
    rows = rows.where((F.length("line") > 3) & (F.length("line") < 80) & ~F.col("line").rlike("[.!?:;]$"))
    own = F.filter(F.split("line", "[ \\t]+"), lambda w: w != "")
    upper = F.size(F.filter(own, lambda w: w.rlike("^\\p{Lu}")))
    marked = F.col("line").startswith("#")
    rows = rows.where(marked | (F.size(own).between(2, 10) & (upper >= 0.6 * F.size(own))))
    rows = rows.select("doc_id", "line_no", F.when(marked, X.strip(F.regexp_replace("line", "^[# ]+", ""))).otherwise(F.col("line")).alias("heading"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("doc_id", "pos", "heading")
