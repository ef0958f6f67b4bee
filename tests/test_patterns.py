from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from studyloom import fixtures
from studyloom.functions import lexicon as L
from studyloom.operators import annotate, definitions, facts


@pytest.fixture(scope="module")
def sents(spark):
    rows = annotate.annotate(fixtures.sentences(spark)).persist()
    return rows, annotate.sentences(rows)


@pytest.fixture(scope="module")
def found(sents):
    rows, s = sents
    return {r.doc_id: r for r in definitions.extract(s, annotate.chunk_counts(annotate.chunks(rows))).collect()}


def test_definitions(found):
    got = {k: (r.term, r.pattern, round(r.confidence, 4)) for k, r in found.items() if k < 20}
    assert got == {
        1: ("valve", "copular", 0.8), 2: ("pump", "copular", 0.8), 3: ("dam", "cue", 0.95), 5: ("suspension bridge", "appos", 0.55),
        6: ("lute", "hypernym", 0.8), 11: ("delta", "copular", 0.8), 12: ("delta", "copular", 0.8), 13: ("lute", "copular", 0.8),
    }
    assert found[3].definition == "A strong wall of stone."
    assert "and mud" in found[11].definition
    assert "percussion" not in found[13].definition


@pytest.mark.parametrize("doc", [4, 7, 8, 9, 10])
def test_no_definition(found, doc):
    assert doc not in found


def test_every_fact_pattern_fires(sents):
    assert {r.pattern for r in facts.candidates(sents[1]).select("pattern").distinct().collect()} == set(L.FAMILY)


def test_facts(sents):
    rows = facts.extract(sents[1]).collect()
    got = {(r.doc_id, r.pattern): r for r in rows}
    clock = got[21, "consist_of"]
    assert (clock.term, clock.back, clock.confidence) == ("clock", "Gears with a spring and two brass hands.", 0.85)
    assert (got[25, "difference_between"].term, got[25, "difference_between"].other) == ("lute", "harp")
    assert "do not require" in got[26, "unlike"].back and got[26, "unlike"].other == "ferries"
    assert "sorts" in got[29, "ordered_chain"].back and "joins" in got[29, "ordered_chain"].back
    assert not [r for r in rows if r.doc_id == 27]
    assert not [r for r in rows if "changes it" in r.back]
    assert not [r for r in rows if r.pattern == "temporal_advcl"]
    assert not [r for r in rows if r.term.lower() == "engines"]


def test_facts_are_extractive(sents):
    for r in facts.extract(sents[1]).collect():
        assert r.back.rstrip(".").lower() in r.evidence.lower()


def test_temporal_clauses_need_a_keyword(sents, spark):
    scores = sents[1].select("doc_id", "index").withColumn("score", F.lit(1.0)).withColumn("high", F.lit(1.0)).withColumn("middle", F.lit(0.5))
    keys = spark.createDataFrame([(31, "flood"), (32, "hot steam")], "doc_id long, key string")
    rows = {r.doc_id: r for r in facts.extract(sents[1], scores, keys).where("pattern = 'temporal_advcl'").collect()}
    assert set(rows) == {31, 32}
    assert "same town" in rows[31].back
    assert not rows[32].back.startswith("When") and "pushed into the cylinder" in rows[32].back
