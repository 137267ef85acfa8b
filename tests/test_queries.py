"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillon.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    result = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in sorted(columns)]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_queries_without_sql_run(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, DATA).count() > 0
