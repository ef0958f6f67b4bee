"""Requests as rows: validation, clamping, errors as rows beside the good ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import clamp


@dataclass(frozen=True)
class Options:
    """How much of each kind a plan gives back."""

    max_cards: int = L.OPTION_RANGES["max_cards"][0]
    max_quiz_questions: int = L.OPTION_RANGES["max_quiz_questions"][0]
    include_cloze: bool = False
    max_keywords: int = L.OPTION_RANGES["max_keywords"][0]
    max_summary_sentences: int = L.OPTION_RANGES["max_summary_sentences"][0]

    def __post_init__(self) -> None:
        for name, (_, least, most) in L.OPTION_RANGES.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be between {least} and {most}")

    @classmethod
    def part(cls, name: str, limit: int) -> Options:
        """Options of a request for one part, its limit brought into range."""
        limit = max(1, limit)
        if name == "cards":
            return cls(max_cards=min(limit, 200), include_cloze=True)
        field, most = {"quiz": ("max_quiz_questions", 100), "keywords": ("max_keywords", 100), "summary": ("max_summary_sentences", 50)}[name]
        return cls(**{field: min(limit, most)})


def problem(text: Column, title: Column | None = None, max_chars: int = L.MAX_TEXT_CHARS) -> Column:
    """(status_code, message) of a bad request, or null."""
    out = F.when(text.isNull() | (F.length(text) < 1), F.struct(F.lit(422).alias("status_code"), F.lit("text: at least 1 character").alias("message")))
    out = out.when(F.length(text) > max_chars, F.struct(F.lit(413).alias("status_code"), F.format_string("text: %d characters, at most %d", F.length(text), F.lit(max_chars)).alias("message")))
    if title is not None:
        out = out.when(F.length(title) > L.MAX_TITLE_CHARS, F.struct(F.lit(422).alias("status_code"), F.lit(f"title: at most {L.MAX_TITLE_CHARS} characters").alias("message")))
    return out


def option_problem(values: dict[str, Column]) -> Column:
    """The first option out of its range as (status_code, message), or null."""
    out = None
    for name, value in values.items():
        _, least, most = L.OPTION_RANGES[name]
        found = F.struct(F.lit(422).alias("status_code"), F.lit(f"options.{name}: between {least} and {most}").alias("message"))
        out = F.when(~value.between(least, most), found) if out is None else out.when(~value.between(least, most), found)
    return out if out is not None else F.lit(None)


def split(docs: DataFrame, text_col: str = "text", max_chars: int = L.MAX_TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows: doc_id, status, status_code, message)."""
    marked = docs.withColumn("problem", problem(F.col(text_col), max_chars=max_chars))
    bad = marked.where("problem is not null").select("doc_id", F.lit(False).alias("status"), "problem.status_code", "problem.message")
    return marked.where("problem is null").drop("problem"), bad


def clamped(limit: Column | str, most: int) -> Column:
    return clamp(limit, most)
