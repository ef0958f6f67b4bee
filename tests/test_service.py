"""Settings in use, health, stats, errors, the lexicon and where it is missing."""

from __future__ import annotations

import json

import pytest

from studyloom import __version__, fixtures
from studyloom.operators import annotate, cards, rules
from studyloom.plans.analyse import Analysis
from studyloom.sources import jobs, relations, requests, service, state
from studyloom.sources.requests import Options
from studyloom.sources.settings import NAMES, Settings
from studyloom.streaming import jobs as stream


def test_settings_have_names_and_defaults(monkeypatch):
    for name in NAMES.values():
        monkeypatch.delenv(name, raising=False)
    assert Settings.load() == Settings() and set(NAMES) == set(Settings.__dataclass_fields__)
    monkeypatch.setenv("STUDYLOOM_QUEUE", "answers")
    monkeypatch.setenv("STUDYLOOM_FILES_PER_TRIGGER", "7")
    assert (Settings.load().default_queue, Settings.load().files_per_trigger) == ("answers", 7)


def test_health(spark):
    row = service.health(spark, Settings()).first()
    assert (row.status, row.model, row.model_loaded, row.version) == ("ok", "rules", True, __version__) and row.uptime_seconds >= 0
    row = service.health(spark, Settings(annotator="no_such_model")).first()
    assert (row.status, row.model_loaded) == ("loading", False)


def test_stats(spark, tmp_path):
    settings = Settings(corpus_path=str(tmp_path / "corpus"))
    assert service.stats(spark, settings).first().documents == 0
    state.save(spark.createDataFrame([("a", 2)], "term string, df long"), 5, settings.corpus_path)
    assert tuple(service.stats(spark, settings).first()) == (5, "rules", "files")


def test_rejected_requests(spark):
    docs = spark.createDataFrame([(1, "good"), (2, None), (3, "x" * 9)], "doc_id long, text string")
    found = service.rejected(requests.split(docs, max_chars=8)[1], "/analyse").collect()
    assert sorted((r.doc_id, r.status, r.statusCode, r.message, r.path) for r in found) == [
        (2, False, 422, ["text: at least 1 character"], "/analyse"), (3, False, 413, ["text: 9 characters, at most 8"], "/analyse"),
    ]


def test_failures(spark):
    docs = spark.createDataFrame([(1, "A valve is a small device.")], "doc_id long, text string")
    with pytest.raises(Exception) as missing:
        annotate.annotate(docs, annotator=service.annotator(Settings(annotator="no_such_model"))).collect()
    assert service.failure(spark, missing.value, "/analyse").first().statusCode == 503
    row = service.failure(spark, ValueError("secret detail"), "/quiz").first()
    assert (row.status, row.statusCode, row.message, row.path) == (False, 500, ["The text could not be processed."], "/quiz")
    assert service.annotator(Settings()) is rules.annotate


def test_lexicon(spark, tmp_path):
    path = str(tmp_path / "relations")
    rows = [(*r, 1) for r in fixtures.RELATIONS] + [(*fixtures.RELATIONS[0], 2), (None, "same", "b", 3), ("a", "unknown", "b", 4)]
    spark.createDataFrame(rows, "term string, relation string, other string, more int").write.parquet(path)
    assert sorted(map(tuple, relations.load(spark, path).collect())) == sorted(fixtures.RELATIONS)


@pytest.mark.parametrize("kind", ["absent", "other columns"])
def test_without_a_lexicon(spark, tmp_path, kind):
    path = str(tmp_path / "relations")
    if kind == "other columns":
        spark.range(3).write.parquet(path)
    with pytest.warns(UserWarning, match="no lexicon"):
        empty = relations.load(spark, path)
    assert empty.columns == ["term", "relation", "other"] and empty.isEmpty()
    found = cards.term_distractors(fixtures.terms(spark), fixtures.terms(spark), empty).collect()
    assert {r.term for r in found} >= {"stack", "queue"}
    assert relations.load(spark, None).isEmpty()


def test_a_stream_by_its_settings(spark, tmp_path):
    places = {name: str(tmp_path / name) for name in ("job_path", "result_path", "dead_path", "corpus_path", "checkpoint_path")}
    (tmp_path / "job_path").mkdir()
    lines = ['{"job_id": "a", "text": "A valve is a small device."}', '{"job_id": "b", "text": "' + "x" * 99 + '"}']
    (tmp_path / "job_path" / "one.json").write_text("\n".join(lines))
    query = stream.start(spark, Settings(max_text_chars=50, default_queue="answers", **places))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    found = spark.read.json(places["result_path"]).collect()
    assert {r.queue for r in found} == {"answers"}
    assert {r.correlation: json.loads(r.message)["error"] for r in found} == {"a": None, "b": "text: 99 characters, at most 50"}


def test_every_job_has_its_own_limits(spark):
    given = [{}, {"max_cards": 2, "max_keywords": 3}, {"max_cards": 9, "include_cloze": True, "max_summary_sentences": 2}, {"max_quiz_questions": 1}, {"max_cards": 0}]
    lines = [(json.dumps({"job_id": str(n), "text": fixtures.LESSON, "options": o}),) for n, o in enumerate(given)]
    found, _ = stream.answers(jobs.parse(spark.createDataFrame(lines, "value string")), spark.createDataFrame([], "term string, df long"), 0)
    results = {int(r.job_id): json.loads(r.result) for r in found.collect()}
    docs = spark.createDataFrame([(1, fixtures.LESSON)], "doc_id long, text string")
    for n, options in enumerate(given):
        alone = Analysis(docs, Options(**{**options, **({"max_cards": 1} if options.get("max_cards") == 0 else {})})).result().toJSON().first()
        for name in ("cards", "quiz", "summary"):
            assert results[n].get(name) == json.loads(alone).get(name), (n, name)
        assert len(results[n]["keywords"]) == options.get("max_keywords", len(results[0]["keywords"]))
