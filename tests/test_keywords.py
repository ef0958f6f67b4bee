"""Keywords of documents that have phrases but no vocabulary, against SQL."""

from __future__ import annotations

import duckdb
import pytest

from studyloom import catalog

TEXTS = [(1, "A valve opens the pump."), *((i, f"The pump moves a load of stone number {i}.") for i in range(2, 9)), (9, "n ci"), (10, "pump valve"), (11, ""), (12, None)]


def test_a_document_without_vocabulary_is_scored_as_in_sql(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(path)
    rows = {(r.doc_id, r.key): r for r in catalog.queries()["kw_topk"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    said = con.execute(f"SELECT doc_id, key, place, term, score, count FROM ({catalog.oracle_sql()['kw_topk']})").fetchall()
    assert len(rows) == len(said) and (9, "n ci") in rows
    for doc, key, *rest in said:
        r = rows[doc, key]
        assert [r.place, r.term, r["count"]] == [rest[0], rest[1], rest[3]] and r.score == pytest.approx(rest[2], abs=1e-9)
