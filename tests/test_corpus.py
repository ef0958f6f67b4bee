"""Document frequencies of keywords where they are asked for, against counting by hand."""

from __future__ import annotations

import pytest

from studyloom.operators import corpus, digest
from studyloom.plans.analyse import Analysis

ROWS = [
    (1, ["a", "b"], ["a", "x"]), (2, ["a"], ["a", "b", "a b"]), (3, [], ["a"]), (4, None, None), (7, ["a", "c"], ["c"]), (7, ["b", "c"], ["a"]), (9, ["c", "b", "a"], ["c", "b", "a"]),
    (None, ["a"], ["a"]), (-5, ["b"], []), (1 << 40, ["c", "a"], ["a", "c"]), ((1 << 40) + 1, ["a"], ["a"]),
]


def by_hand(seen: dict, before: int) -> dict:
    out = {None: (0, {})}
    for doc in {r[0] for r in ROWS} - {None}:
        earlier = [set(t or []) for d, t, _ in ROWS if d is not None and d < doc]
        own = {x for d, t, _ in ROWS if d == doc for x in t or []}
        asked = {x for d, _, k in ROWS if d == doc for x in k or []} & own
        known = {k: n for k in asked if (n := sum(k in t for t in earlier) + seen.get(k, 0))}
        out[doc] = sum(map(bool, earlier)) + before, known
    return out


@pytest.mark.parametrize(("size", "seen"), [(2, {}), (4096, {"a": 10, "z": 3})])
def test_frequencies_at_keys(spark, monkeypatch, size, seen):
    monkeypatch.setattr(corpus, "RANGE_ROWS", size)
    monkeypatch.setattr(corpus, "UNEVEN", 2)
    rows = spark.createDataFrame(ROWS, "doc_id long, terms array<string>, keys array<string>")
    got = corpus.asked(rows, spark.createDataFrame([*seen.items()], "term string, df long") if seen else None, 4 if seen else 0)
    assert {r.doc_id: (r.documents, r.known) for r in got.collect()} == by_hand(seen, 4 if seen else 0)


def test_keywords_of_a_repeated_id_come_once(spark):
    text = "The valve opens the pump. The pump moves water through the valve."
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (3, text)], "doc_id long, text string")
    rows = Analysis(docs).keywords.collect()
    assert len(rows) == len({(r.doc_id, r.key) for r in rows})


def test_phrases_move_as_strings_and_come_back(spark):
    docs = spark.createDataFrame([(1, "The old valve opens the pump.\nA pump\x00 moves the load."), (2, ""), (3, None)], "doc_id long, text string")
    made = digest.digest(docs, of=(digest.PHRASES,))
    assert sorted(digest.gathered_phrases(made).collect()) == sorted(digest.phrases(made).collect()) != []


def test_the_whole_plan_keeps_only_topics_that_facts_name(spark):
    docs = spark.createDataFrame([(1, "A pump has a heavy valve. The river bank opens the mill house in the old town.")], "doc_id long, text string")
    assert "topics" in Analysis(docs).annotated.columns
