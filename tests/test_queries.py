"""Every catalogue query against its DuckDB twin on the smallest tables, and the entry's contract."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from mediaquarry.plans import catalog_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def _cell(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog_queries.SQL))
def test_same_rows(spark, duck, name):
    df = catalog_queries.QUERIES[name](spark, FOLDER)
    twin = duck.execute(catalog_queries.SQL[name])
    columns = [d[0] for d in twin.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, twin.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["sha256", "files", "bytes", "wasted"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalog_queries.QUERIES) - set(catalog_queries.SQL)))
def test_runs(spark, name):
    assert catalog_queries.QUERIES[name](spark, FOLDER).count() >= 0
