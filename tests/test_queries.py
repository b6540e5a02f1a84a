"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from sievework.plans.all_queries import QUERIES, SQL
from sievework.plans.session import TABLES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    kinds = dict(zip(found.columns, map(str, found.types)))
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds
    place = [found.columns.index(c) for c in df.columns]
    assert sorted([plain(v) for v in r] for r in df.collect()) == sorted([plain(r[i]) for i in place] for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.queries().keys() >= e.oracle_sql().keys()
    assert set(QUERIES) <= set(e.queries())
    if sf.startswith("/root/testdata"):
        assert e.entry(spark).columns == ["p_brand", "p_partkey", "p_size", "rank", "tie"]
