"""Every query that SQL can express against DuckDB, and the entry point."""

from __future__ import annotations

import pytest

from larder import queries

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(queries.SQL) == set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, compare, name):
    compare(spark, name)


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.count() == 798
    assert got.columns == ["req_id", "key", "cached", "hit", "served"]


def test_flagship_reads_only_what_it_needs(spark):
    plan = queries.gate_method(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_replay_figures(spark):
    got = queries.replay_swr(spark, "/root/testdata/sf0.01")
    assert (got.count(), got.where("hit").count(), got.where("served IS NULL").count()) == (8019, 7828, 38)
