from __future__ import annotations

import hashlib
import hmac
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from studyloom import fixtures
from studyloom.functions import text as X
from studyloom.sources import jobs, requests, state, webhook
from studyloom.sources.requests import Options
from studyloom.sources.settings import Settings
from studyloom.streaming import jobs as stream


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression("x")).first()[0]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (X.normalise, "a b­c \t d\n\n\n\ne ", "a bc d\n\ne"),
        (X.collapse, " a\n b\tc ", "a b c"),
        (X.strip_list_marker, " (12) item", "item"),
        (X.strip_list_marker, "- item", "item"),
        (X.clean_definition, "a linear\nstructure", "A linear structure."),
        (X.clean_term, "the a binary tree of", "binary tree"),
        (X.display_form, "the binary tree", "Binary tree"),
        (X.normalise_key, "a the tree", "tree"),
        (X.back_key, "A  Tree..", "a tree"),
        (X.strip_article, "The stack", "stack"),
        (X.normalise, None, None),
    ],
)
def test_text(spark, function, value, expected):
    assert one(spark, function, value) == expected


def test_blank_takes_whole_words_only(spark):
    rows = spark.createDataFrame([("We listen to a List of (c++) names", "list"), ("x", "y"), ("a.b axb", "a.b")], "s string, t string")
    assert [r[0] for r in rows.select(X.blank_first("s", "t")).collect()] == ["We listen to a _____ of (c++) names", None, "_____ axb"]


def test_options():
    with pytest.raises(ValueError):
        Options(max_cards=0)
    assert Options.part("quiz", 500).max_quiz_questions == 100
    assert Options.part("cards", -1).max_cards == 1 and Options.part("cards", 3).include_cloze


def test_requests_split(spark):
    docs = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "y" * 11)], "doc_id long, text string")
    good, bad = requests.split(docs, max_chars=10)
    assert [r.doc_id for r in good.collect()] == [1]
    assert {r.doc_id: r.status_code for r in bad.collect()} == {2: 422, 3: 422, 4: 413}


def test_jobs(spark):
    parsed = jobs.parse(fixtures.job_lines(spark))
    assert {r.value for r in jobs.dead_letters(parsed).collect()} == {'{"job_id": "j3"}', "not a job"}
    routed = jobs.route(parsed.where("is_good").withColumn("error", F.lit(None).cast("string")).withColumn("result", F.lit("r"))).collect()
    assert {(r.queue, r.correlation) for r in routed} == {("q1", "c1"), ("results", "j2"), ("results", "j4")}
    assert json.loads(routed[0].message) == {"jobId": "j1", "correlationId": "c1", "ok": True, "error": None, "result": "r"}


def test_state(spark, tmp_path):
    path = str(tmp_path / "corpus")
    frequencies, documents = state.load(spark, path)
    assert frequencies.count() == 0 and documents == 0
    vocab = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "doc_id long, terms array<string>")
    merged, total = state.observe(frequencies, documents, vocab)
    state.save(merged, total.first()[0], path)
    frequencies, documents = state.load(spark, path)
    assert documents == 2 and {r.term: r.df for r in frequencies.collect()} == {"a": 2, "b": 1}


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "state")
    vocab = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "doc_id long, terms array<string>")
    for batch in ("x-0", "x-1", "x-1", "x-2", "x-2", "x-3", "x-4"):
        frequencies, documents = state.load(spark, path, batch)
        merged, total = state.observe(frequencies, documents, vocab)
        state.save(merged, total.first()[0], path, batch)
    frequencies, documents = state.load(spark, path)
    assert documents == 10 and {r.term: r.df for r in frequencies.collect()} == {"a": 10, "b": 5}
    assert len(os.listdir(path)) == state.KEPT
    assert state.load(spark, path, "x-4")[1] == 8


def test_webhook():
    sent, waits = [], []

    def send(statuses):
        left = list(statuses)
        return lambda url, body, headers: (sent.append((body, headers)), left.pop(0))[1]

    assert webhook.deliver("u", {"a": 1}, "s", send([500, None, 200]), waits.append) and waits == [0.5, 2.0]
    assert sent[0][1]["X-Signature"] == "sha256=" + hmac.new(b"s", b'{"a":1}', hashlib.sha256).hexdigest()
    assert not webhook.deliver("u", {}, "s", send([404]), waits.append)
    assert not webhook.deliver("u", {}, "s", send([429, 503, 500]), waits.append)


def test_rows_are_delivered_by_partition(spark):
    rows = spark.createDataFrame([(f"http://host/{i}", f'{{"n": {i}}}', "more") for i in range(6)], "url string, message string, delivered string")
    found = webhook.deliver_rows(rows.repartition(3), "s", lambda url, body, headers: 200 if url < "http://host/3" else 404, lambda seconds: None)
    assert sorted(tuple(r) for r in found.collect()) == [(f"http://host/{i}", f'{{"n": {i}}}', i < 3) for i in range(6)]
    assert not webhook.deliver_rows(rows.limit(0), "s").count()


def test_settings(monkeypatch):
    monkeypatch.setenv("STUDYLOOM_MAX_TEXT_CHARS", "many")
    with pytest.warns(UserWarning):
        assert Settings.load().max_text_chars == 500_000
    assert not Settings.load.__self__().use_vectors


def test_a_stream_stops_behind_its_batch(spark, tmp_path):
    source = tmp_path / "jobs"
    source.mkdir()
    (source / "one.json").write_text(fixtures.JOBS[0])
    paths = [str(tmp_path / name) for name in ("results", "dead", "state", "checkpoint")]
    stop = threading.Event()
    query = stream.run(spark, str(source), *paths)
    query.processAllAvailable()
    stop.set()
    stream.serve(query, stop)
    assert not query.isActive and spark.read.json(paths[0]).count() == 1


def test_stream(spark, tmp_path):
    source = tmp_path / "jobs"
    source.mkdir()
    (source / "one.json").write_text("\n".join(fixtures.JOBS))
    paths = {name: str(tmp_path / name) for name in ("results", "dead", "state", "checkpoint")}
    query = stream.run(spark, str(source), paths["results"], paths["dead"], paths["state"], paths["checkpoint"])
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = {r.correlation: json.loads(r.message) for r in spark.read.json(paths["results"]).collect()}
    assert set(rows) == {"c1", "j2", "j4"}
    assert rows["c1"]["ok"] and not rows["j4"]["ok"]
    assert json.loads(rows["c1"]["result"])["cards"][0]["front"] == "valve"
    assert {r.value for r in spark.read.text(paths["dead"]).collect()} == {'{"job_id": "j3"}', "not a job"}
    assert state.load(spark, paths["state"])[1] == 2
    assert os.path.isdir(paths["checkpoint"])
