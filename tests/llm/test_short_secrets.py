"""Secrets that are short, unquoted, in URLs or without a word that announces them."""

from __future__ import annotations

import random

import pytest

from studyloom.llm import secret
from studyloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def forest():
    return secret.fit()


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("set password: hunter2abc\nthen go", "hunter2abc"),
        ("see postgres://user:pa55word@host/db now", "pa55word"),
        ("url=postgres://user:pa55word@host/db", "pa55word"),
        ("pwd=Tr0ub4dor&3", "Tr0ub4dor&3"),
        ("DB_PASSWORD=swordfishy\n", "swordfishy"),
        ("password = 'xK9!'", "xK9!"),
        ("API_KEY=9f86d081884c7d659a2feaa0c55ad015", "9f86d081884c7d659a2feaa0c55ad015"),
        ("x?a=b&token=k3Jf92LmQz81PdYw0s", "k3Jf92LmQz81PdYw0s"),
        ("host=db;Password=Zq8rTw2p;x=1", "Zq8rTw2p"),
        ("found ghp_a8Kd02LmQz81PdYw0sVb7Nc5Xe3Rt9Uy1Iok lying about", "ghp_a8Kd02LmQz81PdYw0sVb7Nc5Xe3Rt9Uy1Iok"),
    ],
)
def test_is_a_candidate_and_a_secret(forest, text, value):
    import numpy as np

    spans = secret.candidates(text)
    assert value in [text[a:b] for a, b in spans]
    scores = forest.predict(np.array([secret.row_of(text, s, "src0") for s in spans]))
    assert [s >= secret.CUT for s, (a, b) in zip(scores, spans, strict=True) if text[a:b] == value] == [True]


@pytest.mark.parametrize("text", ["Note: this is plain text", "password: string", "at 12:30:45 we met", "timeout=30, retries=5", "std::vector and a == b", "key: value", "PASSWORD=${DB_PASSWORD}", "see https://host/path:8080 here", "color: red; size: 12px"])
def test_is_no_secret(forest, text):
    import numpy as np

    spans = secret.candidates(text)
    assert not spans or (forest.predict(np.array([secret.row_of(text, s, "src0") for s in spans])) < secret.CUT).all()


JWT = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
BLOCK = "-----BEGIN {0}-----\nMIIEpAIBAAKCAQEA0Z3VS5JJcds3xfn/ygWyF0qJ8bXg3oJ9bT6uVYkE2mRr7vq7X\n8xC3W1r2p9VwQm5ZtLk0aHs4dJfGbNcXyUiOe6TqWvRz1KlPo+M3\n-----END {0}-----"


def test_signed_tokens_and_armoured_blocks_are_one_candidate_each(spark):
    path = tokenizer_path("word_bpe_49k.json")
    for forest in (secret.fit(), secret.fit(vocabulary=path)):
        texts = [f"Authorization: Bearer {JWT}", f"it was {JWT} then", "key\n" + BLOCK.format("RSA PRIVATE KEY") + "\nend", "cert\n" + BLOCK.format("CERTIFICATE") + "\nend"]
        docs = spark.createDataFrame([(i, t, "src0", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, findings int")
        rows = {r.doc_id: r.text for r in secret.redact(secret.scan(docs, forest)).collect()}
        assert {r.doc_id: r.text for r in secret.scan(docs, forest, mark=secret.MARK).collect()} == rows
        assert [rows[i] for i in range(4)] == ["Authorization: Bearer [SECRET]", "it was [SECRET] then", "key\n[SECRET]\nend", texts[3]]


def test_the_dictionary_is_that_of_the_vocabulary():
    known = secret.dictionary(tokenizer_path("word_bpe_49k.json"))
    assert len(known.words) > 10_000 and known.covered("qqpasswordqq") == 8 and known.covered("") == known.covered("x7f") == 0
    brute = [w for w in ("horse", "battery") if w in known.words]
    assert known.covered("horsebattery") >= sum(map(len, brute)) == 12


def test_many_secrets_in_a_long_text_are_redacted_once_each():
    values = [f"token = 'é{i}'" for i in range(20_000)]
    text = " ".join(values)
    found, at = [], 0
    for v in values:
        found.append({"start": at + 9, "end": at + len(v) - 1, "is_secret": True})
        at += len(v) + 1
    assert secret.redacted(text, found, "[S]") == " ".join(["token = '[S]'"] * 20_000)
    spans = [(10 * i, 10 * i + 5) for i in range(50)]
    rng = random.Random(1)
    for _ in range(300):
        a = rng.randint(0, 490)
        b = a + rng.randint(1, 30)
        assert bool(secret.outside([(a, b)], spans)) == (not any(a < y and x < b for x, y in spans))
