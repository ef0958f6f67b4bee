from __future__ import annotations

import math

import pytest

from studyloom import fixtures
from studyloom.operators import annotate, cards, corpus, ranking, salience, surface
from studyloom.plans.analyse import Analysis
from studyloom.sources.requests import Options

NAMES = "stack queue list tree graph heap set map trie table array buffer".split()


@pytest.fixture(scope="module")
def lesson(spark):
    return Analysis(fixtures.lesson(spark), Options(include_cloze=True))


def test_cards(lesson):
    rows = lesson.cards.collect()
    fronts = [r.front for r in rows]
    assert len(fronts) == len(set(fronts)) <= 25
    assert any("vs." in f for f in fronts)
    assert [r.kind for r in rows][:1] == ["DEFINITION"]
    for term in ("valve", "pump", "suspension bridge"):
        assert sum(r.front == term or r.front.startswith((f"{term} ")) for r in rows if r.kind != "CLOZE") <= 3
    for r in rows:
        if r.kind == "CLOZE":
            assert "_____" in r.front


def test_no_cloze_by_default_and_no_quiz_at_zero(spark):
    a = Analysis(fixtures.lesson(spark), Options(max_cards=12, max_quiz_questions=0))
    assert not a.cards.where("kind = 'CLOZE'").count()
    assert a.quiz.collect() == []


def test_quiz(lesson):
    rows = lesson.quiz.collect()
    assert rows
    for r in rows:
        assert len(r.options) == 4 and r.options[r.correct_index] == r.explanation


def test_summary_and_stats(lesson):
    rows = sorted(lesson.summary.collect(), key=lambda r: r["index"])
    assert len(rows) == 5
    stats = lesson.stats.first()
    assert stats.sentences == 12


def test_result_is_one_row(lesson):
    row = lesson.result().first()
    assert row.cards and row.quiz and row.keywords and len(row.summary) == 5


def test_graph_scores_sum_to_one(spark):
    text = " ".join(f"A {n} is a linear data structure that stores {n} values in order." for n in NAMES)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    sents = annotate.sentences(annotate.annotate(docs))
    rows = ranking.rank_sentences(sents).collect()
    assert len(rows) == 12 and abs(sum(r.score for r in rows) - 1) < 0.01


def test_short_documents_rank_by_frequency(spark):
    docs = spark.createDataFrame([(1, fixtures.SENTENCES[1] + " " + fixtures.SENTENCES[2])], "doc_id long, text string")
    sents = annotate.sentences(annotate.annotate(docs))
    assert sorted(ranking.rank_sentences(sents).collect()) == sorted(ranking.frequency_rank(sents).collect())


def test_articles_don_t_hide_keywords(lesson):
    keys = {r.key for r in salience.salient_keys(lesson.all_keywords).collect()}
    assert "valve" in keys and "a valve" not in keys


def test_pagerank_handles_dangling_rows():
    import numpy as np

    scores = ranking.pagerank(4, np.array([0]), np.array([1]), np.array([1.0]))
    assert abs(scores.sum() - 1) < 1e-9 and scores[0] == pytest.approx(scores[1]) and scores[2] == pytest.approx(scores[3])
    assert ranking.pagerank(0, *[np.zeros(0)] * 3).tolist() == [] and ranking.pagerank(1, *[np.zeros(0)] * 3).tolist() == [1.0]


def test_idf_values(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, 0), (3, 0), (5, 2), (10, 10)], "n int, df int")
    got = [r[0] for r in rows.select(corpus.idf(F.col("n"), F.col("df"))).collect()]
    assert got[0] == pytest.approx(0.7)
    assert got[1] == pytest.approx(0.4 * 0.7 + 0.6 * (math.log(4) + 1))
    assert got[2] == pytest.approx(math.log(6 / 3) + 1)
    assert got[3] == pytest.approx(1.0)


def test_running_sum_is_the_plain_one(spark):
    rows = [(i, f"k{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, k string")
    got = {r.seq: r.before for r in corpus.running_sum(df, "seq", ("k",), ranges=7).collect()}
    assert got == {i: sum(j % 3 == i % 3 for j in range(i)) for i in range(200)}


def test_selection_limits(spark):
    none = spark.createDataFrame([], "doc_id long, ord int, front string, back string, kind string, confidence double, evidence string")
    rows = sorted(cards.fact_cards(none, fixtures.fact_rows(spark), 20).collect())
    tree = [r for r in rows if r.doc_id == 1 and r.front.lower().startswith("tree")]
    assert [r.kind for r in tree] == ["PROPERTY", "PURPOSE", "PROCESS"]
    assert "stack vs. queue" in [r.front for r in rows]
    assert [r.front for r in rows if r.doc_id == 1 and r.front.startswith("list")] == ["list"]


def test_term_distractors(spark):
    rows = cards.term_distractors(fixtures.terms(spark), fixtures.terms(spark), fixtures.relations(spark)).where("term = 'linked list'").orderBy("place").collect()
    assert [r.wrong for r in rows][0] == "array list"
    assert "list" not in [r.wrong for r in rows] and "data structure" not in [r.wrong for r in rows]


def test_surface_handles_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n "), (4, "x" * 5000), (4, "x" * 5000)], "doc_id long, text string")
    for df in (surface.sentences(docs), surface.usable_sentences(docs), surface.vocabulary(docs), surface.phrases(docs), surface.definitions(docs)):
        df.collect()
    assert annotate.annotate(docs).count() == 5


def test_wider_terms_in_a_circle_and_in_long_chains(spark):
    circle = [("a", "wider", "b"), ("b", "wider", "c"), ("c", "wider", "a"), ("x", "same", "y"), (None, "wider", "z")]
    rows = spark.createDataFrame(circle, "term string, relation string, other string")
    assert {tuple(r) for r in cards.unreliable(rows).collect()} == {(p, q) for p in "abc" for q in "abc"} | {("x", "y")}
    chain = spark.createDataFrame([(f"t{i:03}", "wider", f"t{i + 1:03}") for i in range(130)], rows.schema)
    assert cards.unreliable(chain).count() == 131 * 130 // 2


def test_running_sums_over_any_order(spark):
    values = [-(1 << 62), -5, -5, 0, 7, 1 << 62, (1 << 62) + 1]
    rows = spark.createDataFrame([(v,) for v in values], "seq long")
    for ranges in (1, 3, 100):
        got = sorted((r.seq, r.before) for r in corpus.running_sum(rows, "seq", ranges=ranges).collect())
        assert got == [(v, sum(w < v for w in values)) for v in values]
    assert corpus.running_sum(rows.limit(0), "seq").count() == 0
