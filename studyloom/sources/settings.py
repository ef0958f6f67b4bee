"""Settings from the environment, each with a default; a number that is none falls back to it."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass


def number(name: str, default: int) -> int:
    raw = os.environ.get(name)
    if raw is None or not raw.strip():
        return default
    try:
        return int(raw)
    except ValueError:
        warnings.warn(f"{name} is no number; using {default}", stacklevel=2)
        return default


NAMES = {
    "annotator": "STUDYLOOM_ANNOTATOR", "max_text_chars": "STUDYLOOM_MAX_TEXT_CHARS", "corpus_path": "STUDYLOOM_CORPUS", "job_path": "STUDYLOOM_JOBS", "result_path": "STUDYLOOM_RESULTS",
    "default_queue": "STUDYLOOM_QUEUE", "files_per_trigger": "STUDYLOOM_FILES_PER_TRIGGER", "transport": "STUDYLOOM_TRANSPORT", "dead_path": "STUDYLOOM_DEAD", "checkpoint_path": "STUDYLOOM_CHECKPOINT", "lexicon_path": "STUDYLOOM_LEXICON",
}


@dataclass(frozen=True)
class Settings:
    annotator: str = "rules"
    max_text_chars: int = 500_000
    corpus_path: str = "corpus"
    job_path: str = "jobs"
    result_path: str = "results"
    default_queue: str = "results"
    files_per_trigger: int = 1
    transport: str = "files"
    dead_path: str = "dead"
    checkpoint_path: str = "checkpoint"
    lexicon_path: str = ""

    @property
    def use_vectors(self) -> bool:
        """Only models with whole vector tables have similarities worth a band."""
        return self.annotator.endswith(("_lg", "_trf"))

    @classmethod
    def load(cls) -> Settings:
        text = {field: os.environ.get(name) or getattr(cls, field) for field, name in NAMES.items() if isinstance(getattr(cls, field), str)}
        numbers = {field: number(name, getattr(cls, field)) for field, name in NAMES.items() if field not in text}
        return cls(**text, **numbers)
