"""What a running engine says of itself, and the one form of its errors."""

from __future__ import annotations

import importlib.util
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators import annotate, rules
from . import state
from .settings import Settings

STARTED = time.monotonic()
ENVELOPE = "status boolean, statusCode int, message array<string>, path string"
MISSING, FAILED = 503, 500


def annotator(settings: Settings) -> annotate.Annotator:
    """The annotator that the settings name: the rules, or an installed parser."""
    return rules.annotate if settings.annotator == "rules" else annotate.parser(settings.annotator)


def is_ready(settings: Settings) -> bool:
    """Whether the annotator can be had, without loading a model for the question."""
    return settings.annotator == "rules" or all(importlib.util.find_spec(name) for name in ("spacy", settings.annotator))


def health(spark: SparkSession, settings: Settings) -> DataFrame:
    """One row: status (ok or loading), model, model_loaded, version, uptime_seconds."""
    ready = is_ready(settings)
    row = ("ok" if ready else "loading", settings.annotator, ready, __version__, round(time.monotonic() - STARTED, 1))
    return spark.createDataFrame([row], "status string, model string, model_loaded boolean, version string, uptime_seconds double")


def stats(spark: SparkSession, settings: Settings) -> DataFrame:
    """One row: the number of documents that the corpus state has seen, model, transport."""
    seen = state.load(spark, settings.corpus_path)[1]
    return spark.createDataFrame([(seen, settings.annotator, settings.transport)], "documents long, model string, transport string")


def rejected(bad: DataFrame, path: str) -> DataFrame:
    """Error rows of requests.split in the form of every error: doc_id, status, statusCode, message (a list), path."""
    return bad.select("doc_id", "status", F.col("status_code").alias("statusCode"), F.array("message").alias("message"), F.lit(path).alias("path"))


def failure(spark: SparkSession, error: Exception, path: str) -> DataFrame:
    """A failed plan in that form: 503 where a model is not installed, otherwise 500 without inner details."""
    missing = annotate.NOT_INSTALLED in str(error)
    message = "The language model is not available." if missing else "The text could not be processed."
    return spark.createDataFrame([(False, MISSING if missing else FAILED, [message], path)], ENVELOPE)
