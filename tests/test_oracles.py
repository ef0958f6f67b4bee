"""Every query that has SQL gives its rows, over whole small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from studyloom import catalog

DATA = os.environ.get("STUDYLOOM_DATA", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(x):
    return repr(round(x, 9)) if isinstance(x, float) else repr(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, engine, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    relation = engine.sql(SQL[name])
    at = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert sorted(tuple(map(plain, r)) for r in df.select(columns).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


def test_names_match():
    assert set(SQL) <= set(catalog.queries())
