"""Every query with SQL equals it on DuckDB; the others run and keep their schema."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quillon.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def norm(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(norm, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(norm, r)) for r in df.select(*names).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    if name == "grid_search":
        pytest.skip("test_search runs it on less")
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
