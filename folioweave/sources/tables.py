"""Star-schema tables seen as a graph: rows are anchors, foreign keys are edges, events are details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.store import GraphStore

SOURCE = "store"
_NODES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "part": "p_partkey"}
#: Child table, kind of the edge's start, its key, kind of the edge's end, its key, relation, time of the edge.
_EDGES = (
    ("nation", "region", "n_regionkey", "nation", "n_nationkey", "has_part", None),
    ("customer", "nation", "c_nationkey", "customer", "c_custkey", "home_of", None),
    ("supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "home_of", None),
    ("orders", "customer", "o_custkey", "orders", "o_orderkey", "placed", "o_orderdate"),
)


#: Schemas by session and path: to look one up reads a file's footer in a job of its own.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table below ``sf_dir``; its files are listed each time, its schema is looked up once a session."""
    path = f"{sf_dir}/{name}.parquet"
    at = (spark.sparkContext.applicationId, path)
    if at not in _SCHEMAS:
        _SCHEMAS[at] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[at]).parquet(path)


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """The rows dealt by ``key`` over three tasks a core, where much is worked out of each.

    A table's file is split by its size, which says little about that: some MB hold a million rows.
    """
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, *[F.col(c) for c in key])


class TableGraph(GraphStore):
    """The store of the tables below a folder; an anchor's serial is its key. A table of it is planned when it is first asked for.

    Kinds are literals, so that a filter on the kind prunes the tables that aren't of it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        object.__setattr__(self, "_of", (spark, sf_dir))

    def anchors_of(self, kind: str) -> DataFrame:
        return _anchors(*self._of, kind) if kind in _NODES else super().anchors_of(kind)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _PLANS:
            raise AttributeError(name)
        made = _PLANS[name](*self._of)
        object.__setattr__(self, name, made)
        return made


def graph(spark: SparkSession, sf_dir: str) -> GraphStore:
    return TableGraph(spark, sf_dir)


def _key(c: str) -> Column:
    return F.col(c).cast("string")


def _anchors(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(c).cast("long").alias("serial"), F.lit(SOURCE).alias("source"), _key(c).alias("key")) for t, c in _NODES.items() if t in (kinds or _NODES)
    ])


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.lit("event").alias("kind"), F.col("event_id").alias("serial"), F.col("event_type").alias("source"), _key("user_id").alias("key"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.lit(None).cast("timestamp_ntz").alias("time_source"), F.col("ts").alias("time_sys"), F.col("props").alias("record"), F.md5("props").alias("record_hash"), F.lit("application/json").alias("media_type"),
    )


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        table(spark, sf_dir, t).select(
            F.lit(a).alias("kind_from"), F.lit(b).alias("kind_to"), F.col(kb).cast("long").alias("serial"), F.lit(SOURCE).alias("source_from"), _key(ka).alias("key_from"), F.lit(rel).alias("relation_kind"),
            F.lit(SOURCE).alias("source_to"), _key(kb).alias("key_to"), F.lit("p0").alias("provider"), (F.col(at) if at else F.lit(None)).cast("timestamp_ntz").alias("time_sys"), F.lit(None).cast("timestamp_ntz").alias("time_source"),
        ) for t, a, ka, b, kb, rel, at in _EDGES
    ])


_PLANS = {"anchors": _anchors, "details": _details, "relations": _relations}
