"""Jobs as JSON lines, and results as JSON on their way to a queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPTIONS = "struct<max_cards:int,max_quiz_questions:int,include_cloze:boolean,max_keywords:int,max_summary_sentences:int>"
JOB = f"job_id string, text string, title string, options {OPTIONS}, reply_to string, correlation_id string, broken string"
DEFAULT_QUEUE = "results"


def parse(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """lines with the fields of the job; is_good is false for what is no job."""
    job = F.from_json(F.col(value_col).cast("string"), JOB, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = lines.withColumn("job", job)
    good = F.col("job").isNotNull() & F.col("job.broken").isNull() & F.col("job.job_id").isNotNull() & F.col("job.text").isNotNull()
    return rows.select(*lines.columns, *(F.col(f"job.{c}").alias(c) for c in ("job_id", "text", "title", "options", "reply_to", "correlation_id")), F.coalesce(good, F.lit(False)).alias("is_good"))


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("is_good"))


def queue(reply_to: Column, default: str = DEFAULT_QUEUE) -> Column:
    return F.coalesce(reply_to, F.lit(default))


def correlation(correlation_id: Column, job_id: Column) -> Column:
    return F.coalesce(correlation_id, job_id)


def envelope(job_id: Column, correlation_id: Column, error: Column, result: Column) -> Column:
    """The message that answers a job."""
    return F.to_json(F.struct(job_id.alias("jobId"), correlation_id.alias("correlationId"), error.isNull().alias("ok"), error.alias("error"), result.alias("result")), {"ignoreNullFields": "false"})


def route(results: DataFrame, default: str = DEFAULT_QUEUE) -> DataFrame:
    """queue, correlation and message of each row of job_id, correlation_id, reply_to, error, result."""
    return results.select(
        queue(F.col("reply_to"), default).alias("queue"), correlation(F.col("correlation_id"), F.col("job_id")).alias("correlation"), envelope(F.col("job_id"), F.col("correlation_id"), F.col("error"), F.col("result")).alias("message")
    )


def write(routed: DataFrame, path: str) -> None:
    """One folder for each queue."""
    routed.write.mode("append").partitionBy("queue").json(path)
