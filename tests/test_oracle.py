"""Every query with SQL against DuckDB over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from histframe import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("null" if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, small, name):
    df = catalog.QUERIES[name](spark, small)
    got = _rows(df.columns, df.collect())
    if name not in catalog.ORACLES:
        assert got or name == "range_diff"
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == _rows(want.columns, want.fetchall())


def test_sql_names_are_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
