"""The pipeline and the thin queries over small tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from studyloom.llm import queries as Q

DATA = os.environ.get("STUDYLOOM_DATA", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_rows_are_those_of_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    relation = con.sql(Q.oracle_sql()[name])
    at = [relation.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in df.select(columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall())


@needs_tables
def test_the_pipeline_takes_decisions_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in Q.queries()["op8_quality_rules"](spark, DATA).where("kept").collect()}
    columns = docs.columns
    after = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if number < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after[number] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert after[0] == kept and after[1] <= after[0] and after[2] <= after[1] and after[3] == after[2] == after[4]
    leaked = {r.doc_id for r in Q.queries()["op6_decontaminate"](spark, DATA).where("contaminated").collect()}
    assert after[2] == after[1] - leaked
    redacted = spark.read.parquet(str(tmp_path / "3"))
    assert not redacted.where(F.col("text").rlike("(?i)token = \"[0-9a-f]{40}")).count()
    run = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert run == {(r.doc_id, r.ids_sha256) for r in docs.collect()}


@needs_tables
def test_predictions_of_held_out_rows(spark):
    found = Q.queries()["op5_language"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    scored = Q.queries()["op2_quality"](spark, DATA).collect()
    assert all(0 <= r.score <= 1 for r in scored)
