"""Queries on tables larger than the given ones, and what they write on the way."""

from __future__ import annotations

import os

import duckdb
import pytest

from mediaquarry.operators import similarity
from mediaquarry.plans import catalog_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the benchmark tables are not here")


def test_human_size_beyond_a_terabyte(spark, tmp_path):
    """Customers' numbers as in tables 60 times sf0.1: labels of 1,024 GB and more."""
    path = tmp_path / "orders.parquet"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (o_custkey + 890000 AS o_custkey) FROM read_parquet('{FOLDER}/orders.parquet')) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{path}')")
    want = sorted(con.execute(catalog_queries.SQL["q119_human_size"]).fetchall())
    assert any(float(label.split()[0]) > 1024 for _, label in want if label.endswith("GB"))
    got = catalog_queries.QUERIES["q119_human_size"](spark, str(tmp_path)).select("o_orderkey", "label").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["q152_video_rebuild", "q151_approved_pairs", "q155_add_arrivals", "q155_rebuild_for_many_arrivals"])
def test_compared_pairs_are_never_a_table(spark, name):
    """Blocks meet and approved pairs leave: no pair is shuffled, sorted or joined to its samples."""
    plan = catalog_queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "MapInArrow" in plan
    assert not any(node in plan for node in ("Exchange", "SortMergeJoin", "HashJoin"))


@pytest.mark.parametrize("name", ["q150_photo_rebuild", "q153_greedy_clusters", "q150_ranked_groups", "q087_worst_score"])
def test_clusters_need_no_table_of_links(spark, monkeypatch, name):
    def listed(*_, **__):
        raise AssertionError("all links are listed")

    for operator in ("radius_pairs", "approve", "clusters"):
        monkeypatch.setattr(similarity, operator, listed)
    assert catalog_queries.QUERIES[name](spark, FOLDER).count() > 0
