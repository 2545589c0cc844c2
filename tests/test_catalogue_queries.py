"""Every catalogue query against its SQL in DuckDB, and the plans that the scale needs."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from folioweave import queries
from folioweave.operators import ingest
from folioweave.operators import store as S
from folioweave.sources.tables import graph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df, columns):
    own = df[columns].astype(str).replace({"nan": "None", "NaT": "None", "<NA>": "None"})
    return sorted(map(tuple, own.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyset_page_takes_the_top_rows(spark):
    text = plan(S.list_kind(graph(spark, SF), "orders", after=500))
    assert "TakeOrderedAndProject" in text and "PushedFilters: [IsNotNull(o_orderkey)" in text and "customer.parquet" not in text


def test_node_sets_are_broadcast_and_upserts_are_anti_joins(spark):
    g = graph(spark, SF)
    nodes = spark.createDataFrame([("customer", "store", "7")], "kind string, source string, key string")
    edges = plan(S.lookup_relations(g, nodes))
    assert "LeftSemi" in edges and "BroadcastHashJoin" in edges and "WindowGroupLimit" in edges
    assert "LeftAnti" in plan(ingest.prepare(queries._order_tuples(spark, SF), g).relations)


def test_kind_prunes_partitions_of_a_written_store(spark, tmp_path):
    graph(spark, SF).write(str(tmp_path))
    store = S.GraphStore.read(spark, str(tmp_path))
    assert "PartitionFilters: [isnotnull(kind" in plan(S.list_kind(store, "nation"))
    assert S.list_kind(store, "nation").count() == 25


def test_aggregates_look_only_at_what_is_asked_for(spark):
    """The node set is joined below the aggregation."""
    g = graph(spark, SF)
    nodes = spark.createDataFrame([("customer", "store", "7")], "kind string, source string, key string")
    counted = plan(S.degrees(g, nodes))
    assert counted.index("HashAggregate") < counted.index("LeftSemi")
    edges = S.lookup_relations(g, nodes, limit=100)
    enriched = plan(S.with_latest_detail(edges, g))
    assert "LeftSemi" in enriched[enriched.index("SortAggregate" if "SortAggregate" in enriched else "HashAggregate") :]


def test_large_pages_rank_shares_of_a_pair_first(spark):
    g = graph(spark, SF)
    nodes = spark.createDataFrame([("nation", "store", str(k)) for k in range(25)], "kind string, source string, key string")
    few, many = S.lookup_relations(g, nodes, limit=20), S.lookup_relations(g, nodes, limit=5000)
    assert "share" in plan(many) and "share" not in plan(few) and plan(few).count("WindowGroupLimit") == 2
    assert many.count() == spark.read.parquet(f"{SF}/customer.parquet").count() + spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_minting_sorts_once(spark):
    new = ingest.mint_serials(spark.createDataFrame([(f"k{k:03d}",) for k in range(500)], "key string"), 10, ["key"])
    assert [tuple(r) for r in new.orderBy("serial").collect()] == [(f"k{k:03d}", 11 + k) for k in range(500)] and "Window" not in plan(new)


def test_large_node_sets_are_not_broadcast(spark, monkeypatch):
    nodes = spark.createDataFrame([("customer", "store", "7" * 100)], "kind string, source string, key string")
    assert S.few(nodes)
    monkeypatch.setattr(S, "SMALL_BYTES", 50)
    assert not S.few(nodes)
