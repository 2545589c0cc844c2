"""Path patterns over the graph as plain Python values; each becomes DataFrame joins.

A pattern is a start node and hops. The kinds a hop can lead to come from the kinds that edges join,
a table of at most kinds × kinds rows; everything else is one lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE, NODE
from ..operators.store import GraphStore

OUT, IN, BOTH = "out", "in", "both"


@dataclass(frozen=True)
class Node:
    """A node of a pattern: its kind, none for any, and values its anchor columns must have."""

    kind: str | None = None
    where: dict[str, str | Column] = field(default_factory=dict)
    name: str | None = None


@dataclass(frozen=True)
class Hop:
    """A step along an edge of one of the relation kinds (any if none) to a node."""

    to: Node = field(default_factory=Node)
    relations: tuple[str, ...] = ()
    direction: str = OUT


def _fits(node: Node, prefix: str) -> Column:
    cond = F.lit(True) if node.kind is None else F.col(f"{prefix}kind") == node.kind
    for name, value in node.where.items():
        cond = cond & (F.col(f"{prefix}{name}") == F.lit(value))
    return cond


def _edges(relations: DataFrame, hop: Hop) -> DataFrame:
    """Edges seen along the hop: (near…, far…) besides their own columns."""
    rows = relations.where(F.col("relation_kind").isin(list(hop.relations))) if hop.relations else relations
    seen = []
    for near, far, on in (("from", "to", hop.direction in (OUT, BOTH)), ("to", "from", hop.direction in (IN, BOTH))):
        if on:
            seen.append(rows.select(*[F.col(f"{c}_{near}").alias(f"near_{c}") for c in NODE], *[F.col(f"{c}_{far}").alias(f"far_{c}") for c in NODE], *EDGE))
    return reduce(DataFrame.unionByName, seen)


def match(store: GraphStore, start: Node, *hops: Hop, prefixes: bool = True, returning: list[str] | None = None) -> DataFrame:
    """Edges that end a match of ``start`` and ``hops``, once each.

    With ``prefixes`` each beginning of the path of one hop or more counts as a match too. The columns
    are (kind_from, source_from, key_from, kind_to, source_to, key_to) of the last edge; with
    ``returning``, of full paths only, "name.column" of the named nodes' anchors.
    """
    anchors = store.anchors
    frontier = anchors.where(_fits(start, "")).select(*[F.col(c).alias(f"at_{c}") for c in NODE], *_named(start))
    found = []
    for step, hop in enumerate(hops):
        edges = _edges(store.relations, hop)
        # The kind is known in most patterns: said on the edge too, it prunes the partitions read.
        if hop.to.kind is not None:
            edges = edges.where(F.col("far_kind") == hop.to.kind)
        near = start.kind if step == 0 else hops[step - 1].to.kind
        if near is not None:
            edges = edges.where(F.col("near_kind") == near)
        met = frontier.join(edges, [F.col(f"at_{c}") == F.col(f"near_{c}") for c in NODE])
        held = [c for c in frontier.columns if "." in c]
        target = anchors.where(_fits(hop.to, "")).select(*[F.col(c).alias(f"far_{c}") for c in NODE], *_named(hop.to))
        met = met.join(target, [f"far_{c}" for c in NODE])
        ends = ["kind_from", "source_from", "key_from", "kind_to", "source_to", "key_to"]
        if prefixes or step == len(hops) - 1:
            found.append(met.select(*ends))
        named = [F.col(f"`{c}`") for c in dict.fromkeys([*held, *[c for c in target.columns if "." in c]])]
        frontier = met.select(*[F.col(f"far_{c}").alias(f"at_{c}") for c in NODE], *named)
    if returning is not None:
        return frontier.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in returning]).distinct()
    return reduce(DataFrame.unionByName, found).distinct()


def _named(node: Node) -> list[Column]:
    return [F.col(c).alias(f"{node.name}.{c}") for c in (*NODE, "serial")] if node.name else []


def kind_paths(store: GraphStore, start: str | None, length: int) -> list[tuple[str, ...]]:
    """Paths of kinds along edges of up to ``length`` hops, from a start kind or any."""
    pairs = sorted((r["kind_from"], r["kind_to"]) for r in store.relations.select("kind_from", "kind_to").distinct().collect())
    paths = [(a,) for a in sorted({a for a, _ in pairs}) if start in (None, a)]
    found: list[tuple[str, ...]] = []
    for _ in range(length):
        paths = [(*p, b) for p in paths for a, b in pairs if a == p[-1]]
        found += paths
    return found


def merge_each(rows: DataFrame, start: Node, *hops: Hop) -> DataFrame:
    """Entity and relation tuples that a pattern stands for in each of the rows, for import.

    Values of nodes are texts or columns of ``rows``. A node's key is its ``where`` key or its name. A hop gives an edge
    for each of its relation kinds, two for either direction; a hop without relation kinds gives none. Tuples come in
    order of ``input_pos`` within a row; nodes and edges that several rows name are told each time.
    """
    nodes = [start, *[h.to for h in hops]]
    value = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    of = lambda n: (value(n.kind), value(n.where.get("source")), value(n.where.get("key", n.name)))
    names, blank = [*NODE, "kind_from", "source_from", "key_from", "relation_kind", "kind_to", "source_to", "key_to"], value(None)
    made = [(*of(n), *[blank] * 7) for n in nodes]
    for k, hop in enumerate(hops):
        a, b = of(nodes[k]), of(nodes[k + 1])
        for relation in hop.relations:
            made += [(blank, blank, blank, *one, value(relation), *two) for one, two in {OUT: [(a, b)], IN: [(b, a)], BOTH: [(b, a), (a, b)]}[hop.direction]]
    each = F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, row, strict=True)]) for row in made])
    first = F.monotonically_increasing_id() * len(made)
    return rows.select(first.alias("__first"), F.posexplode(each).alias("__at", "__t")).select("__t.*", (F.col("__first") + F.col("__at")).alias("input_pos"))


def merge_tuples(spark: SparkSession, start: Node, *hops: Hop) -> DataFrame:
    """The tuples of one pattern to be created, all of whose values are texts."""
    return merge_each(spark.range(1), start, *hops)
