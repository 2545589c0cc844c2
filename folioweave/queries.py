"""The catalogue's queries over the driver's tables, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, ranges, text, vectors
from .operators import ingest, operations, stats, vocabulary
from .operators import store as S
from .plans import feed, patterns
from .sources import quads
from .sources.tables import graph, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _customers(spark: SparkSession, sf_dir: str, segment: str = "BUILDING") -> DataFrame:
    own = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == segment)
    return own.select(F.lit("customer").alias("kind"), F.lit("store").alias("source"), F.col("c_custkey").cast("string").alias("key"))


# Look-ups


@query("SELECT o_orderkey AS serial, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 100")
def keyset_page(spark, d):
    return S.list_kind(graph(spark, d), "orders", after=5000).select("serial", "key")


@query("SELECT o_orderkey AS serial FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def keyset_page_ascending(spark, d):
    nodes = spark.createDataFrame([("orders", "store")], "kind string, source string")
    return S.query_anchors(graph(spark, d), nodes, after=100, limit=50, ascending=True).select("serial")


@query("SELECT event_type AS source, CAST(user_id AS VARCHAR) AS key, event_id AS serial, props AS record FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1")
def latest_version(spark, d):
    return S.newest(graph(spark, d).details).select("source", "key", "serial", "record")


@query("SELECT event_type AS source, CAST(user_id AS VARCHAR) AS key, event_id AS serial FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1 ORDER BY event_id DESC LIMIT 25")
def entity_page(spark, d):
    return S.query_entities(graph(spark, d), limit=25).select("source", "key", "serial")


@query("SELECT event_type AS source, CAST(user_id AS VARCHAR) AS key, max(event_id) AS serial FROM (SELECT * FROM events WHERE event_id < 900 ORDER BY event_id DESC LIMIT 40) x GROUP BY 1, 2")
def entity_page_limit_first(spark, d):
    return S.query_entities(graph(spark, d), after=900, limit=40, limit_before_dedup=True).select("source", "key", "serial")


@query("SELECT event_type AS source, CAST(user_id AS VARCHAR) AS key, max(event_id) AS serial FROM events WHERE (user_id, event_type) IN (SELECT user_id, event_type FROM events WHERE event_id <= 5) GROUP BY 1, 2")
def node_tuple_filter(spark, d):
    first = table(spark, d, "events").where("event_id <= 5")
    nodes = first.select(F.lit(" Event ").alias("kind"), "event_type", F.col("user_id").cast("string").alias("key")).withColumnRenamed("event_type", "source")
    return S.query_entities(graph(spark, d), nodes).select("source", "key", "serial")


@query("SELECT event_type AS source, CAST(user_id AS VARCHAR) AS key, max(event_id) AS serial FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2 ORDER BY serial DESC LIMIT 5000")
def time_range(spark, d):
    found = S.query_entities(graph(spark, d), limit=5000, since=datetime(2024, 1, 3), until=datetime(2024, 1, 20, 12))
    return found.select("source", "key", "serial")


@query("SELECT kind, CAST(n AS BIGINT) AS n FROM (SELECT 'region' AS kind, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part) t")
def count_anchors(spark, d):
    return S.count_anchors(graph(spark, d))


@query("SELECT 'region' AS kind_from, 'nation' AS kind_to, count(*) AS n FROM nation UNION ALL SELECT 'nation', 'customer', count(*) FROM customer UNION ALL SELECT 'nation', 'supplier', count(*) FROM supplier UNION ALL SELECT 'customer', 'orders', count(*) FROM orders")
def kind_graph(spark, d):
    return S.kind_graph(graph(spark, d))


@query("SELECT CAST(c.c_custkey AS VARCHAR) AS key, coalesce(x.n, 0) AS number_of_items FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) x ON x.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
def out_degree(spark, d):
    return S.degrees(graph(spark, d), _customers(spark, d)).select("key", "number_of_items")


@query("SELECT CAST(c.c_custkey AS VARCHAR) AS key, 1 + coalesce(x.n, 0) AS number_of_items FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) x ON x.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
def both_degrees(spark, d):
    return S.degrees(graph(spark, d), _customers(spark, d), incoming=True).select("key", "number_of_items")


@query("SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM nation WHERE n_regionkey = 7 OR n_nationkey = 7 UNION ALL SELECT count(*) FROM customer WHERE c_nationkey = 7 OR c_custkey = 7 UNION ALL SELECT count(*) FROM supplier WHERE s_nationkey = 7 OR s_suppkey = 7 UNION ALL SELECT count(*) FROM orders WHERE o_custkey = 7 OR o_orderkey = 7) t")
def children_count_any_kind(spark, d):
    return S.count_children(graph(spark, d), "store", "7")


@query("SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM customer WHERE c_custkey = 7 UNION ALL SELECT count(*) FROM orders WHERE o_custkey = 7) t")
def children_count(spark, d):
    return S.count_children(graph(spark, d), "store", "7", "customer")


@query("SELECT kind_to, key_from, key_to, serial FROM (SELECT *, row_number() OVER (PARTITION BY kind_to ORDER BY serial DESC) AS rn FROM (SELECT 'customer' AS kind_to, CAST(c_nationkey AS VARCHAR) AS key_from, CAST(c_custkey AS VARCHAR) AS key_to, c_custkey AS serial FROM customer UNION ALL SELECT 'supplier', CAST(s_nationkey AS VARCHAR), CAST(s_suppkey AS VARCHAR), s_suppkey FROM supplier) r WHERE key_from IN ('1', '2', '3', '4', '5') AND key_from <> key_to OR key_from IN ('1', '2', '3', '4', '5')) z WHERE rn <= 20")
def relations_topk_per_pair(spark, d):
    nodes = spark.createDataFrame([("nation", "store", str(k)) for k in range(1, 6)], "kind string, source string, key string")
    return S.lookup_relations(graph(spark, d), nodes, limit=20).select("kind_to", "key_from", "key_to", "serial")


@query("SELECT kind_to, key_to, serial FROM (SELECT *, row_number() OVER (PARTITION BY kind_to ORDER BY serial DESC) AS rn FROM (SELECT 'customer' AS kind_to, CAST(c_custkey AS VARCHAR) AS key_to, c_custkey AS serial FROM customer WHERE c_nationkey = 3 AND c_custkey < 400 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_suppkey FROM supplier WHERE s_nationkey = 3) r) z WHERE rn <= 10")
def relations_continued(spark, d):
    nodes = spark.createDataFrame([("nation", "store", "3")], "kind string, source string, key string")
    return S.lookup_relations(graph(spark, d), nodes, limit=10, after=("nation", "customer", 400)).select("kind_to", "key_to", "serial")


@query("SELECT direction, key_from, key_to FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY serial DESC) AS rn FROM (SELECT 'outgoing' AS direction, CAST(o_custkey AS VARCHAR) AS key_from, CAST(o_orderkey AS VARCHAR) AS key_to, o_orderkey AS serial FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'incoming', CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR), c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') r) z WHERE rn <= 30")
def relations_both_ways(spark, d):
    return S.lookup_relations(graph(spark, d), _customers(spark, d), limit=30, incoming=True).select("direction", "key_from", "key_to")


@query("SELECT CAST(o.o_orderkey AS VARCHAR) AS key_to, CAST(o.o_custkey AS VARCHAR) AS key_from, e.props AS record FROM orders o LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type = 'click') x WHERE rn = 1) e ON e.user_id = o.o_orderkey")
def left_enrich(spark, d):
    g = graph(spark, d)
    clicks = g.details.where("source = 'click'").withColumns({"kind": F.lit("orders"), "source": F.lit("store")})
    edges = g.relations.where("kind_to = 'orders'")
    return S.with_latest_detail(edges, S.GraphStore(g.anchors, clicks, g.relations)).select("key_from", "key_to", "record")


@query("SELECT CAST(c.c_custkey AS VARCHAR) AS key, e.props AS record FROM customer c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type = 'view') x WHERE rn = 1) e ON e.user_id = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
def details_else_anchors(spark, d):
    g = graph(spark, d)
    views = g.details.where("source = 'view'").withColumns({"kind": F.lit("customer"), "source": F.lit("store")})
    return S.details_else_anchors(S.GraphStore(g.anchors, views, g.relations), _customers(spark, d)).select("key", "record")


@query("SELECT CAST(o_custkey AS VARCHAR) AS key_from, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) x WHERE rn <= 5 GROUP BY 1")
def relation_groups(spark, d):
    groups = S.relation_groups(graph(spark, d).relations.where("kind_to = 'orders'"), 5)
    return groups.select("key_from", F.array_join(F.transform("relations", lambda r: r["key_to"]), ",").alias("keys"))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('url', 'urn', 'uri', 'link', 'href', 'identifier', 'group', 'collection', 'set', 'array', 'list', 'pack', 'bundle', 'series', 'serial', 'concept', 'click')")
def publication_filter(spark, d):
    kind = F.when(F.col("event_type") == "click", "link").otherwise(F.col("event_type"))
    return table(spark, d, "events").where(S.is_publication(kind)).select("event_id")


# Patterns

_HOP1 = "SELECT 'customer' AS kind_from, CAST(c.c_custkey AS VARCHAR) AS key_from, 'orders' AS kind_to, CAST(o.o_orderkey AS VARCHAR) AS key_to FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey"


@query(f"{_HOP1} WHERE c.c_custkey = 7")
def pattern_one_hop(spark, d):
    found = patterns.match(graph(spark, d), patterns.Node("customer", {"key": "7"}), patterns.Hop(patterns.Node("orders")))
    return found.select("kind_from", "key_from", "kind_to", "key_to")


@query("SELECT 'region' AS kind_from, CAST(r_regionkey AS VARCHAR) AS key_from, 'nation' AS kind_to, CAST(n_nationkey AS VARCHAR) AS key_to FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 2 UNION SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'customer', CAST(c_custkey AS VARCHAR) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2 UNION SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'supplier', CAST(s_suppkey AS VARCHAR) FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def pattern_union_of_prefixes(spark, d):
    found = patterns.match(graph(spark, d), patterns.Node("region", {"key": "2"}), patterns.Hop(), patterns.Hop())
    return found.select("kind_from", "key_from", "kind_to", "key_to")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS key_from, CAST(c_custkey AS VARCHAR) AS key_to FROM customer")
def pattern_incoming_typed(spark, d):
    found = patterns.match(graph(spark, d), patterns.Node("customer"), patterns.Hop(patterns.Node("nation"), ("home_of",), patterns.IN))
    return found.select("key_from", "key_to")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_key, CAST(n_nationkey AS VARCHAR) AS n_key, CAST(s_suppkey AS BIGINT) AS s_serial FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def pattern_returning(spark, d):
    n = patterns.Node
    return patterns.match(graph(spark, d), n("region", name="r"), patterns.Hop(n("nation", name="n"), ("has_part",)), patterns.Hop(n("supplier", name="s")), returning=["r.key", "n.key", "s.serial"])


@query("""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS n FROM customer)
    SELECT 'person' AS kind, 'w' AS source, k AS key, NULL AS key_from, NULL AS relation_kind, NULL AS key_to FROM c UNION ALL SELECT 'nation', 'g', n, NULL, NULL, NULL FROM c UNION ALL SELECT 'city', 'g', 'rome', NULL, NULL, NULL FROM c
    UNION ALL SELECT NULL, NULL, NULL, k, 'knows', n FROM c UNION ALL SELECT NULL, NULL, NULL, n, 'knows', k FROM c UNION ALL SELECT NULL, NULL, NULL, 'rome', 'home_of', n FROM c UNION ALL SELECT NULL, NULL, NULL, 'rome', 'seat_of', n FROM c""")
def merge_tuples(spark, d):
    """A pattern of three nodes created for each customer."""
    n = patterns.Node
    own = table(spark, d, "customer")
    found = patterns.merge_each(
        own, n("person", {"source": "w", "key": F.col("c_custkey")}), patterns.Hop(n("nation", {"source": "g", "key": F.col("c_nationkey")}), ("knows",), patterns.BOTH),
        patterns.Hop(n("city", {"source": "g"}, "rome"), ("home_of", "seat_of"), patterns.IN),
    )
    return found.select("kind", "source", "key", "key_from", "relation_kind", "key_to")


# Import and delete


def _order_tuples(spark, d) -> DataFrame:
    """All orders as tuples, each edge twice, some nodes incomplete."""
    own = table(spark, d, "orders")
    edge = own.select(
        F.lit("Customer ").alias("kind_from"), F.lit("STORE").alias("source_from"), F.col("o_custkey").cast("string").alias("key_from"), F.lit("placed").alias("relation_kind"), F.lit("orders").alias("kind_to"),
        F.lit("store").alias("source_to"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 3 == 0, 10_000_000).otherwise(0)).cast("string").alias("key_to"), F.col("o_orderkey").alias("input_pos"),
    )
    node = own.select(F.lit("note").alias("kind"), F.when(F.col("o_orderkey") % 5 != 0, "desk").alias("source"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("record"), F.col("o_orderkey").alias("input_pos"))
    blank = {c: F.lit(None).cast("string") for c in ("kind", "source", "key", "record", "media_type", "kind_from", "source_from", "key_from", "relation_kind", "kind_to", "source_to", "key_to", "provider")}
    full = lambda df: df.withColumns({c: v for c, v in blank.items() if c not in df.columns}).withColumn("time_source", F.lit(None).cast("timestamp_ntz"))
    return full(edge).unionByName(full(edge)).unionByName(full(node))


@query("SELECT CAST(o_orderkey + 10000000 AS VARCHAR) AS key FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 5 <> 0")
def upsert_anchors(spark, d):
    return ingest.prepare(_order_tuples(spark, d), graph(spark, d), "p1").anchors.select("key").distinct()


@query("SELECT CAST(o_custkey AS VARCHAR) AS key_from, CAST(o_orderkey + 10000000 AS VARCHAR) AS key_to FROM orders WHERE o_orderkey % 3 = 0")
def upsert_relations(spark, d):
    return ingest.prepare(_order_tuples(spark, d), graph(spark, d), "p1").relations.select("key_from", "key_to")


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, md5(o_orderstatus) AS record_hash, min(o_orderkey) AS input_pos FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1, 2")
def upsert_details(spark, d):
    return ingest.prepare(_order_tuples(spark, d), graph(spark, d), "p1").details.select("key", "record_hash", "input_pos")


@query("SELECT class, CAST(n AS BIGINT) AS n FROM (SELECT 'relation' AS class, 2 * count(*) AS n FROM orders UNION ALL SELECT 'detail', count(*) FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'reject', count(*) FROM orders WHERE o_orderkey % 5 = 0) t")
def classified_tuples(spark, d):
    return ingest.classify(ingest.normalise(_order_tuples(spark, d))).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT 'relation' AS class, 'customer__orders' AS kind, count(*) AS total, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS affected FROM orders")
def import_report(spark, d):
    return ingest.prepare(_order_tuples(spark, d), graph(spark, d), "p1").report.where("class = 'relation'")


@query("SELECT row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR), CAST(o_orderkey + 10000000 AS VARCHAR)) + (SELECT max(o_orderkey) FROM orders) AS serial, CAST(o_custkey AS VARCHAR) AS key_from, CAST(o_orderkey + 10000000 AS VARCHAR) AS key_to FROM orders WHERE o_orderkey % 3 = 0")
def minted_serials(spark, d):
    batch = ingest.prepare(_order_tuples(spark, d), graph(spark, d), "p1")
    return ingest.minted(batch, graph(spark, d), "relations").select("serial", "key_from", "key_to")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) x WHERE rn = 1")
def batch_dedup_first_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return ingest.first_of_each(rows.withColumn("input_pos", F.col("event_id")), ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("SELECT DISTINCT event_type AS code FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id <= 2)")
def new_sources(spark, d):
    events = table(spark, d, "events")
    return ingest.new_codes(events, "event_type", events.where("event_id <= 2").select(F.col("event_type").alias("code")))


@query("SELECT CAST(o_orderkey AS BIGINT) AS serial FROM orders WHERE o_custkey <> 7")
def cascade_delete_survivors(spark, d):
    left, _ = ingest.cascade(graph(spark, d), "customer", "store", "7")
    return left.relations.where("kind_to = 'orders'").select("serial")


@query("SELECT step, CAST(n AS BIGINT) AS n FROM (SELECT 'incoming' AS step, count(*) AS n FROM customer UNION ALL SELECT 'outgoing', count(*) FROM orders UNION ALL SELECT 'details', 0 UNION ALL SELECT 'anchors', count(*) FROM customer) t")
def cascade_delete_counts(spark, d):
    return ingest.cascade(graph(spark, d), "customer")[1]


# Statistics


@query("SELECT event_type AS source, 'p' || CAST(user_id % 3 AS VARCHAR) AS provider, date_trunc('day', ts) AS since, count(*) AS cnt FROM events GROUP BY 1, 2, 3")
def daily_detail_stats(spark, d):
    return stats.daily_details(graph(spark, d).details).select("source", "provider", "since", "cnt")


@query("SELECT 'orders' AS kind_to, date_trunc('day', o_orderdate) AS since, count(*) AS cnt FROM orders GROUP BY 2")
def daily_relation_stats(spark, d):
    return stats.daily_relations(graph(spark, d).relations.where("kind_to = 'orders'")).select("kind_to", "since", "cnt")


_DAYS = "SELECT event_type, 'p' || CAST(user_id % 3 AS VARCHAR) AS provider, date_trunc('day', ts) AS since, count(*) AS cnt FROM events GROUP BY 1, 2, 3"


@query(f"WITH d AS ({_DAYS}) SELECT event_type AS source, provider, CAST(sum(cnt) AS BIGINT) AS cnt FROM d GROUP BY 1, 2 HAVING sum(cnt) >= 500")
def stats_two_level(spark, d):
    return stats.rolled_up(stats.daily_details(graph(spark, d).details), ["source", "provider"], least=500)


@query(f"WITH d AS ({_DAYS}), e AS (SELECT event_type, provider, sum(cnt) AS cnt FROM d GROUP BY 1, 2) SELECT 'entities' AS what, count(*) AS groups, CAST(sum(cnt) AS BIGINT) AS total FROM e UNION ALL SELECT 'relations', 4, CAST((SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) AS BIGINT)")
def stats_totals(spark, d):
    g = graph(spark, d)
    return stats.totals(stats.rolled_up(stats.daily_details(g.details), ["source", "provider"]), stats.rolled_up(stats.daily_relations(g.relations), ["kind_from", "kind_to"]))


@query("SELECT event_type AS source, 'p' || CAST(user_id % 3 AS VARCHAR) AS provider, date_trunc('day', ts) AS since, count(*) AS cnt FROM events GROUP BY 1, 2, 3")
def stats_refreshed(spark, d):
    details = graph(spark, d).details
    found = stats.merged_daily(stats.daily_details(details.where("serial <= 500")), stats.daily_details(details.where("serial > 500")))
    return found.select("source", "provider", "since", "cnt")


@query("SELECT o_orderstatus, count(*) AS occurrences, arg_min(o_orderpriority, o_orderkey) AS first_value, arg_max(o_orderpriority, o_orderkey) AS last_value, CAST(sum(length(o_orderpriority)) AS BIGINT) AS symbols FROM orders GROUP BY 1")
def field_statistics(spark, d):
    return stats.field_statistics(table(spark, d, "orders"), ["o_orderstatus"], "o_orderpriority", "o_orderkey")


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "documents"), "lang")


@query("SELECT md5(text) AS record_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_versions(spark, d):
    rows = table(spark, d, "documents").groupBy(text.content_hash(F.col("text")).alias("record_hash"))
    return rows.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT class, kind, CAST(2 * n AS BIGINT) AS total, CAST(n AS BIGINT) AS affected FROM (SELECT 'detail' AS class, event_type AS kind, count(*) AS n FROM events GROUP BY 2) t")
def merged_reports(spark, d):
    one = table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("total"))
    a = one.select(F.lit("detail").alias("class"), "kind", "total", F.col("total").alias("affected"))
    return stats.merged_reports(a.unionByName(a.withColumn("affected", F.lit(0).cast("long"))))


# The log of operations


def _operations(spark, d) -> DataFrame:
    """Orders as operations: the status as the state, the priority as the account."""
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("PROCESSING")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("account"), state.alias("state"), F.col("o_orderdate").alias("created_at"),
        F.create_map(F.lit("name"), F.lit("import"), F.lit("api secret"), F.col("o_orderpriority")).alias("parameters"),
    )


@query("SELECT o_orderkey AS id, o_orderdate AS created_at, 'name' AS told FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 300")
def operations_page(spark, d):
    found = operations.listed(_operations(spark, d), ["1-URGENT", "2-HIGH"])
    return found.select("id", "created_at", F.array_join(F.map_keys("parameters"), ",").alias("told"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 100 ORDER BY o_orderdate, o_orderkey LIMIT 20")
def operations_page_ascending(spark, d):
    return operations.listed(_operations(spark, d), power=True, ascending=True, after=100, limit=20).select("id")


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'PROCESSING' END AS state, count(*) AS n, o_orderstatus = 'F' AS final FROM orders GROUP BY 1, 3")
def operations_by_state(spark, d):
    return operations.counted(_operations(spark, d), power=True)


# Vocabularies and joins of a dump


@query("SELECT o_orderkey, coalesce(v.label, o_orderstatus) AS label FROM orders LEFT JOIN (SELECT 'F' AS code, 'finished' AS label UNION ALL SELECT 'O', 'open') v ON v.code = o_orderstatus")
def vocabulary_lookup(spark, d):
    label = vocabulary.translated(F.col("o_orderstatus"), {"F": "finished", "O": "open"})
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"))


@query("SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 3) n ON n_nationkey = c_nationkey")
def vocabulary_join(spark, d):
    labels = table(spark, d, "nation").where("n_nationkey > 3").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code"))
    return vocabulary.joined_labels(rows, "code", labels).select("c_custkey", "label")


@query("SELECT l_orderkey AS item, p_name AS part, o_orderstatus AS instance, s_name AS organization, n_name AS grp FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'F' JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) ON n_nationkey = o_custkey % 25 WHERE l_linenumber <> 2")
def registry_items(spark, d):
    t = lambda n: table(spark, d, n)
    line = t("lineitem")
    copies = line.select(F.struct("l_orderkey", "l_partkey").alias("part_id"), F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("string").alias("num"), (F.col("l_linenumber") == 2).alias("deleted"))
    parts = line.select("l_orderkey", "l_partkey").distinct().join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.struct("l_orderkey", "l_partkey").alias("id"), F.col("l_orderkey").alias("item_id"), "p_name")
    items = t("orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", (F.col("o_custkey") % 25).cast("int").alias("doc_type"), (F.col("o_orderstatus") == "F").alias("deleted"))
    users = t("supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    found = vocabulary.registry_items(copies, parts, items, users, t("nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("id"), "n_name"))
    return found.select(F.col("item.id").alias("item"), F.col("part.p_name").alias("part"), F.col("instance.o_orderstatus").alias("instance"), F.col("organization.s_name").alias("organization"), F.col("group.n_name").alias("grp"))


# Functions


@query("SELECT DISTINCT p_type, trim(lower(regexp_replace(regexp_replace(p_type, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_') AS kind FROM part")
def sanitize_kind(spark, d):
    return table(spark, d, "part").select("p_type", text.sanitize_kind(F.col("p_type")).alias("kind")).distinct()


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS key FROM pages")
def url_to_source_key(spark, d):
    return table(spark, d, "pages").select("page_id", text.host_and_path(F.col("url")).alias("n")).select("page_id", "n.*")


@query("SELECT page_id, CASE WHEN contains(url, 'udc-schema') THEN 'concept_scheme' ELSE 'concept' END AS kind, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS source, lower(regexp_extract(url, '^https?://[^/]+/?(.*)$', 1)) AS key FROM pages")
def uri_to_node(spark, d):
    return table(spark, d, "pages").select("page_id", text.uri_to_node(F.col("url")).alias("n")).select("page_id", "n.*")


@query("SELECT DISTINCT lower(trim(lang)) AS source, CAST(doc_id AS VARCHAR) AS key, md5(text) AS record_hash FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def record_hash(spark, d):
    """Documents as tuples: what import makes of them."""
    own = table(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select(F.lit("doc").alias("kind"), F.concat(F.lit(" "), F.upper("lang")).alias("source"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("record"), "doc_id")
    ends = [F.lit(None).cast("string").alias(c) for c in ("kind_from", "source_from", "key_from", "relation_kind", "kind_to", "source_to", "key_to", "provider")]
    return ingest.normalise(own.select("kind", "source", "key", "record", *ends)).select("source", "key", "record_hash").distinct()


@query("SELECT c_custkey, c_mktsegment AS source, replace(c_name, '#', ' ') AS key FROM customer")
def parsed_identifiers(spark, d):
    own = table(spark, d, "customer").select("c_custkey", text.parse_identifier(F.concat(F.lit(" ("), "c_mktsegment", F.lit(")"), "c_name")).alias("n"))
    return own.select("c_custkey", "n.*")


@query("SELECT c_custkey, '/resources/customer/store/' || lower(replace(c_name, '#', '%23')) || CASE WHEN c_custkey % 2 = 0 THEN '%2Fx' ELSE '' END AS key FROM customer")
def sanitized_keys(spark, d):
    head = F.when(F.col("c_custkey") % 3 == 0, "/resources/Customer/Store/").otherwise("/Customer//Store/")
    key = text.sanitize_key(F.concat(head, text.percent_encoded(F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, "/X").otherwise("")))
    return table(spark, d, "customer").select("c_custkey", key.alias("key"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def lengths_in_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", text.length_in_bytes(F.col("text")).alias("n_bytes"))


@query("SELECT o_orderkey, 'orders-' || CAST(o_orderkey AS VARCHAR) AS cursor, o_orderkey AS serial FROM orders")
def cursors(spark, d):
    cursor = text.encode_cursor(F.lit("orders"), F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", cursor.alias("cursor"), text.decode_cursor(cursor)["serial"].alias("serial"))


@query("SELECT CAST(100 AS BIGINT) AS number_of_items, 'orders-' || CAST(min(o_orderkey) AS VARCHAR) AS after, 'orders-' || CAST(max(o_orderkey) AS VARCHAR) AS before, true AS has_next, true AS has_first FROM (SELECT o_orderkey FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 100) t")
def page_navigation(spark, d):
    return feed.navigation(S.list_kind(graph(spark, d), "orders", after=5000), after=True)


@query("SELECT c_custkey, CAST(c_custkey % 28 + 1 AS INT) AS day_of_month, make_timestamp(1900 + c_custkey % 90, 1 + c_custkey % 12, c_custkey % 28 + 1, 0, 0, 0) AS full_date, make_timestamp(1900 + c_custkey % 90, 12, 31, 0, 0, 0) AS year_end, make_timestamp(1900 + c_custkey % 90, 1, 1, 0, 0, 0) AS year_start FROM customer")
def parsed_dates(spark, d):
    k = F.col("c_custkey")
    year = (F.lit(1900) + k % 90).cast("string")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return table(spark, d, "customer").select(
        "c_custkey", (k % 28 + 1).cast("int").alias("day_of_month"), dates.parse_date(F.concat(year, two(1 + k % 12), two(k % 28 + 1))).alias("full_date"),
        dates.parse_date(year).alias("year_end"), dates.parse_date(F.concat(year, F.lit("uuuu"))).alias("year_start"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN to_timestamp(c_custkey * 1000)::TIMESTAMP ELSE to_timestamp(3000000 + c_custkey * 1000)::TIMESTAMP END AS moment FROM customer")
def epoch_times(spark, d):
    """Seconds for even keys, milliseconds for odd ones."""
    k = F.col("c_custkey")
    moment = dates.epoch_time(F.when(k % 2 == 0, k * 1000).otherwise((k * 1000 + 3_000_000) * 1000))
    return table(spark, d, "customer").select("c_custkey", moment.cast("timestamp_ntz").alias("moment"))


@query("WITH n AS (SELECT l_suppkey, CAST(l_orderkey AS BIGINT) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS run FROM n) SELECT l_suppkey, min(n) AS \"from\", max(n) AS \"to\", count(*) AS size FROM r GROUP BY l_suppkey, run")
def gaps_and_islands(spark, d):
    return ranges.islands(table(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey")


@query("WITH n AS (SELECT DISTINCT n_nationkey AS k, unnest(list_concat([1, 2, 3], range(n_nationkey, n_nationkey + 4), [n_nationkey + 6])) AS v FROM nation), r AS (SELECT k, v, v - row_number() OVER (PARTITION BY k ORDER BY v) AS run FROM n), i AS (SELECT k, min(v) AS a, max(v) AS b FROM r GROUP BY k, run) SELECT CAST(k AS INT) AS n_nationkey, string_agg(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), ',' ORDER BY a) AS runs FROM i GROUP BY k")
def page_ranges(spark, d):
    """Lists such as ``1-3,7..9,9...11,13`` as runs."""
    n = lambda plus: (F.col("n_nationkey") + plus).cast("string")
    spec = F.concat(F.lit("1-3,"), n(0), F.lit(".."), n(2), F.lit(","), n(2), F.lit("..."), n(4), F.lit(","), n(6), F.lit(",x"))
    found = ranges.runs(ranges.range_numbers(spec))
    shown = F.array_join(F.transform(found, lambda r: F.concat_ws("-", r["from"].cast("string"), r["to"].cast("string"))), ",")
    return table(spark, d, "nation").select("n_nationkey", shown.alias("runs"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.l2norm(F.col("embedding")), 6).alias("norm"))


_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings"


@query(f"WITH e AS ({_UNIT}), p AS (SELECT label, unnest(range(0, len(u))) AS i, unnest(u) AS x FROM e), s AS (SELECT label, i, sum(x) AS x FROM p GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS z FROM s GROUP BY 1) SELECT s.label, s.i, round(s.x / n.z, 5) AS x FROM s JOIN n ON n.label = s.label")
def vector_sums(spark, d):
    found = vectors.unit_sum(table(spark, d, "embeddings"), ["label"], "embedding")
    return found.select("label", F.posexplode("vector").alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), F.round("v", 5).alias("x"))


@query(f"WITH e AS ({_UNIT}), q AS (SELECT u AS w FROM e WHERE vec_id = (SELECT min(vec_id) FROM e)) SELECT vec_id, round(1 - list_dot_product(u, w), 5) + 0.0 AS distance FROM e, q ORDER BY 1 - list_dot_product(u, w), vec_id LIMIT 20")
def nearest_vectors(spark, d):
    rows = table(spark, d, "embeddings")
    query_vector = rows.orderBy("vec_id").limit(1).collect()[0]["embedding"]
    return vectors.nearest(rows, query_vector, 20).select("vec_id", (F.round("distance", 5) + 0.0).alias("distance"))


@query("SELECT l_suppkey, round(ln(count(*)), 6) AS weight FROM lineitem GROUP BY 1")
def log_weights(spark, d):
    return stats.log_weights(table(spark, d, "lineitem"), "l_suppkey").select("l_suppkey", F.round("weight", 6).alias("weight"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'name=' || c_name WHEN 1 THEN 'name=' || c_name || ',note=' || c_mktsegment ELSE 'name=' || c_name || ',secretary=' || c_mktsegment END AS kept FROM customer")
def scrubbed_parameters(spark, d):
    k = F.col("c_custkey") % 3
    key = F.when(k == 0, "api secret").when(k == 1, "note").otherwise("secretary")
    params = F.create_map(F.lit("name"), F.col("c_name"), key, F.col("c_mktsegment"), F.lit("my-Secret"), F.lit("x"), F.lit("none"), F.lit(None).cast("string"))
    kept = F.transform(F.map_entries(text.without_secrets(params)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(kept), ",").alias("kept"))


# Formats


@query("SELECT 'http://x.example/' || CAST(c_nationkey AS VARCHAR) AS subject, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def quad_subjects(spark, d):
    line = F.concat(F.lit("<http://x.example/"), F.col("c_nationkey").cast("string"), F.lit("> <http://y.example/"), "c_name", F.lit('> "'), "c_mktsegment", F.lit('"@en .'))
    found = quads.subjects(table(spark, d, "customer").select(line.alias("record")))
    return found.select("subject", F.size("statements").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.transform("statements", lambda q: q["object"]))), ",").alias("segments"))


@query("SELECT CAST(o.o_orderkey AS BIGINT) AS serial, CAST(o.o_custkey AS VARCHAR) AS key_from, CAST(o.o_orderkey AS VARCHAR) AS key_to, e.props AS record FROM (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY o_orderkey DESC LIMIT 100) o LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type = 'click') x WHERE rn = 1) e ON e.user_id = o.o_orderkey")
def newest_relations_with_records(spark, d):
    """The newest 100 edges of the BUILDING customers, with their targets' records."""
    g = graph(spark, d)
    clicks = g.details.where("source = 'click'").withColumns({"kind": F.lit("orders"), "source": F.lit("store")})
    edges = S.lookup_relations(g, _customers(spark, d), limit=100)
    return S.with_latest_detail(edges, S.GraphStore(g.anchors, clicks, g.relations)).select("serial", "key_from", "key_to", "record")


FLAGSHIP = newest_relations_with_records

from . import format_queries, linked_queries  # noqa: E402, F401  (they register their queries too)
