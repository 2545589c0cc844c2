"""The catalogue as three DataFrames, and its look-ups.

Every look-up is a plan over whole tables. Node sets are request parameters: a look-up counts their
rows and bytes first, to a limit, and broadcasts them up to ``SMALL`` and ``SMALL_BYTES`` only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import GROUPING_KINDS, LINK_KINDS, NODE, PAGE_DEFAULT, PAGE_MOST

SMALL, SMALL_BYTES = 100_000, 16 << 20
#: Rows of a group up to which Spark itself keeps the first ones of each partition before it shuffles.
GROUP_LIMIT = 1000


def page_size(limit: int | None) -> int:
    """A page's size: 100 if not given, within 1 and 10 000."""
    return min(PAGE_MOST, max(1, limit)) if limit is not None else PAGE_DEFAULT


def page_sizes(limit: Column) -> Column:
    """``page_size`` of a column of limits."""
    return F.when(limit.isNull(), PAGE_DEFAULT).otherwise(F.least(F.lit(PAGE_MOST), F.greatest(F.lit(1), limit)))


def is_publication(kind: Column) -> Column:
    """Neither a link kind nor a grouping kind."""
    return ~kind.isin(LINK_KINDS + GROUPING_KINDS)


def few(nodes: DataFrame) -> bool:
    """Whether ``nodes`` number ``SMALL`` and take ``SMALL_BYTES`` at most."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in nodes.columns), F.lit(0))
    got = nodes.limit(SMALL + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return got["n"] <= SMALL and got["size"] <= SMALL_BYTES


def planned_small(rows: DataFrame) -> bool:
    """Whether Spark's own estimate of the rows, from the sizes of files, lies below its threshold for broadcasts: then it broadcasts them by itself."""
    most = rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def small(nodes: DataFrame) -> DataFrame:
    """``nodes``, marked for broadcast if they are few; where files tell that they are, they aren't counted."""
    return nodes if planned_small(nodes) or not few(nodes) else F.broadcast(nodes)


def normal_nodes(nodes: DataFrame) -> DataFrame:
    """Kinds, sources and keys trimmed and lower-cased, as they are stored; nodes once each."""
    return nodes.select(*[F.lower(F.trim(c)).alias(c) for c in nodes.columns if c in NODE]).distinct()


@dataclass(frozen=True)
class GraphStore:
    """Anchors (nodes), details (versions of their records) and relations (typed edges)."""

    anchors: DataFrame
    details: DataFrame
    relations: DataFrame

    def anchors_of(self, kind: str) -> DataFrame:
        """The anchors of a kind."""
        return self.anchors.where(F.col("kind") == kind)

    @staticmethod
    def read(spark: SparkSession, path: str) -> GraphStore:
        return GraphStore(*[spark.read.parquet(f"{path}/{t}") for t in ("anchors", "details", "relations")])

    def write(self, path: str, mode: str = "append") -> None:
        """Write the tables, partitioned by kind and sorted by time, so that scans can skip files."""
        self.anchors.sortWithinPartitions("kind", "serial").write.mode(mode).partitionBy("kind").parquet(f"{path}/anchors")
        self.details.sortWithinPartitions("kind", "time_sys").write.mode(mode).partitionBy("kind").parquet(f"{path}/details")
        self.relations.sortWithinPartitions("kind_from", "kind_to", "serial").write.mode(mode).partitionBy("kind_from", "kind_to").parquet(f"{path}/relations")


def _of_nodes(rows: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Rows of the given (kind, source[, key]) nodes; all rows without any given."""
    return rows if nodes is None else rows.join(small(normal_nodes(nodes)), [c for c in NODE if c in nodes.columns], "left_semi")


def _page(rows: DataFrame, after: int | None, limit: int | None, ascending: bool) -> DataFrame:
    if after is not None:
        rows = rows.where(F.col("serial") > after if ascending else F.col("serial") < after)
    by = [F.col("serial") if ascending else F.col("serial").desc(), "kind", "source", "key"]
    return rows.orderBy(*by).limit(page_size(limit))


def newest(details: DataFrame) -> DataFrame:
    """The last version of each node: that of the largest serial.

    Serials of details differ. Only nodes and serials are aggregated, by hash; the versions that they name are looked up
    by semi-join.
    """
    last = details.groupBy(*NODE).agg(F.max("serial").alias("serial"))
    return details.join(last, [*NODE, "serial"], "left_semi")


def query_entities(
    store: GraphStore, nodes: DataFrame | None = None, after: int | None = None, limit: int | None = None,
    since=None, until=None, ascending: bool = False, limit_before_dedup: bool = False,
) -> DataFrame:
    """A page of newest versions by serial, of ``nodes`` if given; both time bounds are inclusive.

    ``limit_before_dedup`` takes the page first and then a node's newest version in it, so a page can
    hold fewer nodes than asked for.
    """
    rows = _of_nodes(store.details, nodes)
    if since is not None:
        rows = rows.where(F.col("time_sys") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("time_sys") <= F.lit(until))
    if limit_before_dedup:
        return newest(_page(rows, after, limit, ascending))
    return _page(newest(rows), after, limit, ascending)


def query_anchors(store: GraphStore, nodes: DataFrame | None = None, after: int | None = None, limit: int | None = None, ascending: bool = False, since=None, until=None) -> DataFrame:
    """A page of anchors by serial; time bounds hold for any of their details."""
    rows = _of_nodes(store.anchors, nodes)
    if since is not None or until is not None:
        seen = store.details
        seen = seen if since is None else seen.where(F.col("time_sys") >= F.lit(since))
        seen = seen if until is None else seen.where(F.col("time_sys") <= F.lit(until))
        rows = rows.join(seen, NODE, "left_semi")
    return _page(rows, after, limit, ascending)


def list_kind(store: GraphStore, kind: str, after: int | None = None, limit: int | None = None) -> DataFrame:
    """A page of a kind's anchors, the newest first."""
    return _page(store.anchors_of(kind.lower()), after, limit, False)


def _edge_ends(direction: str) -> dict[str, str]:
    return {c: f"{c}_{'from' if direction == 'outgoing' else 'to'}" for c in NODE}


def _fits(edges: DataFrame) -> DataFrame:
    """Edges with all ends named, no loops."""
    named = edges.dropna(subset=["source_from", "key_from", "source_to", "key_to"])
    return named.where((F.col("key_from") != F.col("key_to")) | (F.col("source_from") != F.col("source_to")) | (F.col("kind_from") != F.col("kind_to")))


def lookup_relations(
    store: GraphStore, nodes: DataFrame, limit: int | None = None, after: tuple[str, str, int] | None = None,
    outgoing: bool = True, incoming: bool = False,
) -> DataFrame:
    """Edges of ``nodes``, the newest ``limit`` of each pair of kinds and direction.

    ``after`` is the last edge seen, (kind_from, kind_to, serial): pairs before it in order are left
    out, and of its own pair only older edges follow. Each row tells its ``direction``.
    """
    own = normal_nodes(nodes)
    found = []
    for direction in [d for d, on in (("outgoing", outgoing), ("incoming", incoming)) if on]:
        ends = small(own.select(*[F.col(c).alias(e) for c, e in _edge_ends(direction).items()]))
        found.append(_fits(store.relations).join(ends, list(ends.columns), "left_semi").withColumn("direction", F.lit(direction)))
    edges = reduce(DataFrame.unionByName, found)
    if after is not None:
        here, before = F.struct("kind_from", "kind_to"), F.struct(F.lit(after[0]).alias("kind_from"), F.lit(after[1]).alias("kind_to"))
        edges = edges.where((here > before) | ((here == before) & (F.col("serial") < after[2])))
    order = [F.col("serial").desc(), "source_from", "key_from", "source_to", "key_to", "relation_kind"]
    pair, most = ["kind_from", "kind_to", "direction"], page_size(limit)
    if most > GROUP_LIMIT:
        # The first of each of 64 shares of a pair, so that no task ranks a whole pair.
        share = F.pmod(F.xxhash64("source_from", "key_from", "source_to", "key_to"), F.lit(64))
        edges = edges.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy(*pair, "share").orderBy(*order))).where(F.col("rank") <= most).drop("share")
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(*pair).orderBy(*order))).where(F.col("rank") <= most).drop("rank")


def edges_of(store: GraphStore, nodes: DataFrame) -> DataFrame:
    """All outgoing edges of ``nodes``."""
    ends = small(normal_nodes(nodes).select(*[F.col(c).alias(e) for c, e in _edge_ends("outgoing").items()]))
    return _fits(store.relations).join(ends, list(ends.columns), "left_semi")


def degrees(store: GraphStore, nodes: DataFrame, outgoing: bool = True, incoming: bool = False) -> DataFrame:
    """``nodes`` with the number of their edges (number_of_items), 0 where they have none."""
    own, ends = normal_nodes(nodes), []
    wanted = small(own)
    for direction in [d for d, on in (("outgoing", outgoing), ("incoming", incoming)) if on]:
        ends.append(store.relations.select(*[F.col(e).alias(c) for c, e in _edge_ends(direction).items()]).join(wanted, NODE, "left_semi"))
    # Only edges of the nodes are counted, one row a node meets the node set.
    count = reduce(DataFrame.unionByName, ends).groupBy(*NODE).agg(F.count("*").alias("n"))
    return own.join(count, NODE, "left").select(*NODE, F.coalesce("n", F.lit(0)).alias("number_of_items"))


def count_children(store: GraphStore, source: str, key: str, kind: str | None = None) -> DataFrame:
    """The number of edges at a node, either way; of any kind if ``kind`` isn't given."""
    def at(end: str) -> Column:
        same = (F.col(f"source_{end}") == source) & (F.col(f"key_{end}") == key)
        return same if kind is None else same & (F.col(f"kind_{end}") == kind)

    return store.relations.where(at("from") | at("to")).agg(F.count("*").alias("n"))


def count_anchors(store: GraphStore, kind: str | None = None, source: str | None = None, key: str | None = None) -> DataFrame:
    """Anchors by kind, of a source or key if given."""
    rows = store.anchors if kind is None else store.anchors_of(kind)
    for name, value in (("source", source), ("key", key)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def kind_graph(store: GraphStore) -> DataFrame:
    """Each pair of kinds that edges join, with how many."""
    return store.relations.groupBy("kind_from", "kind_to").agg(F.count("*").alias("n"))


def with_latest_detail(edges: DataFrame, store: GraphStore, end: str = "to") -> DataFrame:
    """Edges with their target's newest record where it has one; the edge's serial stays.

    Where the targets are few, only their details are looked at.
    """
    ends = edges.select(*[F.col(f"{c}_{end}").alias(c) for c in NODE]).distinct()
    details = store.details.join(F.broadcast(ends), NODE, "left_semi") if few(ends) else store.details
    last = newest(details).select(*[F.col(c).alias(f"{c}_{end}") for c in NODE], "record", "media_type", F.col("provider").alias("record_provider"), F.col("serial").alias("detail_serial"))
    return edges.join(last, [f"{c}_{end}" for c in NODE], "left")


def details_else_anchors(store: GraphStore, nodes: DataFrame) -> DataFrame:
    """Each known node with its newest record, or without one where it only has an anchor."""
    last = newest(_of_nodes(store.details, nodes)).select(*NODE, "record", "media_type", F.col("serial").alias("detail_serial"))
    return _of_nodes(store.anchors, nodes).join(last, NODE, "left")


def relation_groups(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Each node with its outgoing edges as an array, the newest first, ``limit`` at most."""
    newest_first = Window.partitionBy("kind_from", "source_from", "key_from").orderBy(F.col("serial").desc(), "kind_to", "source_to", "key_to")
    ranked = edges.withColumn("rank", F.row_number().over(newest_first)).where(F.col("rank") <= page_size(limit))
    item = F.struct("rank", "relation_kind", "kind_to", "source_to", "key_to", "serial")
    return ranked.groupBy("kind_from", "source_from", "key_from").agg(F.array_sort(F.collect_list(item)).alias("relations"))


def raw_export(store: GraphStore, kind: str, source: str, key: str, provider: str | None = None) -> DataFrame:
    """A node's newest record as it was delivered, with the name of a file for it: one row at most."""
    own = store.details.where((F.col("kind") == kind) & (F.col("source") == source) & (F.col("key") == key))
    own = own if provider is None else own.where(F.col("provider") == provider)
    name = F.concat_ws("__", F.lit("seed"), "kind", "source", "key", "provider", F.unix_timestamp("time_sys").cast("string"))
    return own.orderBy(F.desc("serial")).limit(1).select(name.alias("file"), "media_type", "record")


def codes(dimension: DataFrame, code: str = "code") -> DataFrame:
    """A dimension (providers, sources) in order of its codes, once each."""
    return dimension.dropDuplicates([code]).orderBy(code)
