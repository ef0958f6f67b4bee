"""Token-tree queries over a table of documents, not over given sentences."""

from __future__ import annotations

import pyarrow as pa
import pytest

from studyloom import catalog, fixtures
from studyloom.functions import lexicon as L
from studyloom.operators import _arrow

LONG = " ".join(fixtures.SENTENCES.values()) + " " + fixtures.LESSON
DOCS = [(10, LONG, "en", "s"), (11, None, "en", "s"), (12, "", "en", None), (13, "palabra " * 3000, "es", "t"), (14, fixtures.SENTENCES[5], "fr", None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def rows(spark, folder, name):
    return catalog.queries()[name](spark, folder).collect()


def test_definitions_of_every_pattern(spark, folder):
    found = rows(spark, folder, "tree_definitions")
    assert {r.doc_id for r in found} == {10, 14}
    assert {r.pattern for r in found if r.doc_id == 10} >= {"copular", "appos"} and [r.pattern for r in found if r.doc_id == 14] == ["appos"]


@pytest.mark.parametrize("pattern", sorted(L.FAMILY))
def test_facts_of_every_pattern(spark, folder, pattern):
    assert {r.doc_id for r in rows(spark, folder, f"tree_fact_{pattern}")} == {10}


def test_whole_plan(spark, folder):
    found = {r.doc_id: r for r in rows(spark, folder, "analyse_result")}
    assert set(found) == {d[0] for d in DOCS}
    assert found[10].cards and found[10].quiz and found[10].keywords and found[10].summary and found[10].stats.sentences > 30
    assert found[11].stats.tokens == found[12].stats.tokens == 0 and found[13].stats.tokens == 3000


@pytest.mark.parametrize("name", ["tree_tokens", "tree_facts", "tree_term_distractors", "analyse_keywords", "analyse_cards", "analyse_quiz", "analyse_summary", "analyse_salience"])
def test_parts_read_the_documents(spark, folder, name):
    assert {r.doc_id for r in rows(spark, folder, name)} >= {10}


def test_jobs(spark, folder):
    assert len(rows(spark, folder, "document_deadletters")) == 1
    found = rows(spark, folder, "document_routes")
    assert sorted((r.queue, r.correlation) for r in found) == [("results", "12"), ("results", "14"), ("s", "10"), ("t", "13")]
    assert all('cards' in r.message or r.correlation != "10" for r in found)


def test_results_leave_in_small_batches(spark, monkeypatch):
    class Frame:
        mapInArrow = staticmethod(lambda run, schema: run)

    monkeypatch.setattr(_arrow, "FLUSH", 10)
    run = _arrow.map_rows(Frame, "x long", lambda i: ((j,) for j in range(35)))
    out = list(run(iter([pa.record_batch({"i": [0]})])))
    assert [b.num_rows for b in out] == [10, 10, 10, 5] and [x for b in out for x in b.column(0).to_pylist()] == list(range(35))
