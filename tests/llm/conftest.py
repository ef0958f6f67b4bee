from __future__ import annotations

import pytest

#: Texts that operators must take: null, empty, blank, long, repeated, with control strings and rare characters.
ODD = [None, "", " \n\t ", "a", "a" * 20_000, "word " * 5_000, "<|endoftext|> \\ <|turn|> </turn>", "é" * 300, "İΣς ﬁ \x00 \x85   ퟿", "1234567890123456", "same text here", "same text here"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd texts, null keys, and a column whose name clashes with what operators add."""
    rows = [(None if i == 3 else i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "s", None, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], DOCS).withColumnRenamed("extra", "n_words")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
