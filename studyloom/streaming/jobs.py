"""Jobs as a stream: JSON lines in, answers by queue out, the corpus moving on after each batch.

A batch is analysed as one table: a document's keywords are weighed by the documents of earlier batches and by those
of its own batch that come before it (by the hash of the job's id). Answers are written before the state, and the checkpoint advances after both: a job may
be answered twice after a crash, never not at all. Each batch writes its own folder and its own version of the state,
which a repeated batch overwrites, so its documents count once.
"""

from __future__ import annotations

import hashlib
import signal
import threading
import time
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import lexicon as L
from ..plans.analyse import Analysis
from ..sources import jobs, requests, service, state
from ..sources.requests import Options
from ..sources.settings import Settings


def source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def answers(parsed: DataFrame, frequencies: DataFrame, documents: int, options: Options = Options(), opened: list[Analysis] | None = None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(job_id, correlation_id, reply_to, error, result), vocabulary of the batch's documents.

    A job's own options override the defaults where they are given; they go through one plan as columns, so it stays the
    same size however many there are. opened takes the analyses, for the caller to close.
    """
    opened = opened if opened is not None else []
    good = parsed.where("is_good").dropDuplicates(["job_id"]).withColumn("doc_id", F.xxhash64("job_id"))
    valid, bad = requests.split(good, max_chars=settings.max_text_chars)
    annotator = service.annotator(settings)
    wanted = valid.select("doc_id", *(fitted(f.name, F.coalesce(F.col(f"options.{f.name}"), F.lit(getattr(options, f.name)))).alias(f.name) for f in fields(Options)))
    analysis = Analysis(valid, options, annotator, frequencies, documents, wanted)
    opened.append(analysis)
    out = analysis.result().select("doc_id", F.to_json(F.struct("cards", "quiz", "keywords", "summary", "stats")).alias("result"))
    done = valid.join(out, "doc_id", "left").select("job_id", "correlation_id", "reply_to", F.lit(None).cast("string").alias("error"), "result")
    failed = good.join(bad, "doc_id").select("job_id", "correlation_id", "reply_to", F.col("message").alias("error"), F.lit(None).cast("string").alias("result"))
    return done.unionByName(failed), analysis.vocabulary


def fitted(name: str, value: Column) -> Column:
    """An option brought into its range."""
    if name not in L.OPTION_RANGES:
        return value
    _, least, most = L.OPTION_RANGES[name]
    return F.greatest(F.lit(least), F.least(value, F.lit(most)))


def run(spark: SparkSession, job_path: str, result_path: str, dead_path: str, state_path: str, checkpoint: str, files_per_trigger: int = 1, settings: Settings = Settings()) -> StreamingQuery:
    """Starts the job stream; stop() the query after the batch in hand. The paths here, not those of settings, hold."""

    # Batches are numbered by checkpoint.
    origin = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(lines: DataFrame, number: int) -> None:
        parsed = jobs.parse(lines).persist()
        name = f"{origin}-{number}"
        opened: list[Analysis] = []
        frequencies, documents = state.load(spark, state_path, name)
        found, vocab = answers(parsed, frequencies, documents, opened=opened, settings=settings)
        jobs.route(found, settings.default_queue).withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("queue").json(f"{result_path}/batch={number}")
        jobs.dead_letters(parsed).select("value").write.mode("overwrite").text(f"{dead_path}/batch={number}")
        merged, total = state.observe(frequencies, documents, vocab)
        state.save(merged, total.first()[0], state_path, name)
        for analysis in opened:
            analysis.close()
        parsed.unpersist()

    return source(spark, job_path, files_per_trigger).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def start(spark: SparkSession, settings: Settings) -> StreamingQuery:
    """The job stream as the settings describe it."""
    return run(spark, settings.job_path, settings.result_path, settings.dead_path, settings.corpus_path, settings.checkpoint_path, settings.files_per_trigger, settings)


def serve(query: StreamingQuery, stop: threading.Event, pause: float = 0.2) -> None:
    """Waits until stop is set, lets the batch in hand end, and stops the query."""
    while query.isActive and not stop.is_set():
        stop.wait(pause)
    while query.isActive and query.status["isTriggerActive"]:
        time.sleep(pause)
    query.stop()


def stop_on_signals() -> threading.Event:
    """An event that an interrupt or a request to terminate sets; for serve, from the main thread."""
    stop = threading.Event()
    for number in (signal.SIGINT, signal.SIGTERM):
        signal.signal(number, lambda *_: stop.set())
    return stop
