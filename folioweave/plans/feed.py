"""Pages, cursors and nested feeds as one row of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import encode_cursor, record_url, sorted_links
from ..model import LINK_KINDS, NODE, PAGE_DEFAULT
from ..operators import store as S


def navigation(page: DataFrame, after: bool, descending: bool = True, edges: bool = False) -> DataFrame:
    """A page's cursors (after, before), size, and whether it has a next and a first link.

    ``next`` is there on descending pages that aren't empty and whose last serial is above 1, ``first``
    on pages that followed a cursor.
    """
    kinds = ["kind_from", "kind_to"] if edges else ["kind"]
    at = F.struct(*kinds, "serial")
    ends = page.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("number_of_items"))
    cursor = lambda s: encode_cursor(*[F.col(f"{s}.{c}") for c in (*kinds, "serial")])
    first, last = ("hi", "lo") if descending else ("lo", "hi")
    filled = F.col("number_of_items") > 0
    has_next = filled & (F.col(f"{last}.serial") > 1) & F.lit(descending)
    return ends.select("number_of_items", F.when(filled, cursor(last)).alias("after"), F.when(filled, cursor(first)).alias("before"), F.coalesce(has_next, F.lit(False)).alias("has_next"), F.lit(after).alias("has_first"))


def publications(store: S.GraphStore, page: DataFrame, base: str, limit: int | None = None) -> DataFrame:
    """A page's nodes as publications: metadata, links in order, and the newest edges of each."""
    related = S.relation_groups(S.edges_of(store, page.select(*NODE)), limit).select(*[F.col(f"{c}_from").alias(c) for c in NODE], "relations")
    degree = S.degrees(store, page.select(*NODE))
    own = page.join(degree, NODE, "left").join(related, NODE, "left")
    url = record_url(base, F.col("kind"), F.col("source"), F.col("key"))
    to = lambda r: F.struct(F.coalesce(r["relation_kind"], F.lit("item")).alias("rel"), record_url(base, r["kind_to"], r["source_to"], r["key_to"]).alias("href"), r["key_to"].alias("title"))
    me = F.array(F.struct(F.lit("self").alias("rel"), url.alias("href"), F.col("key").alias("title")))
    out_links = F.transform(F.filter("relations", lambda r: r["kind_to"].isin(LINK_KINDS)), to)
    links = sorted_links(F.concat(me, F.coalesce(out_links, F.expr("array()").cast("array<struct<rel:string,href:string,title:string>>"))))
    items = F.transform(F.filter("relations", lambda r: ~r["kind_to"].isin(LINK_KINDS)), to)
    return own.select(*NODE, "serial", F.struct(url.alias("identifier"), F.col("number_of_items").alias("numberOfItems")).alias("metadata"), links.alias("links"), items.alias("items"))


def kind_feed(store: S.GraphStore, kind: str, base: str, after: int | None = None, limit: int | None = None) -> DataFrame:
    """The feed of a page of a kind as one JSON string; a page is bounded by its size."""
    page = S.list_kind(store, kind, after, limit)
    pubs = publications(store, page, base)
    nav = navigation(page, after is not None)
    body = pubs.agg(F.array_sort(F.collect_list(F.struct((-F.col("serial")).alias("o"), "metadata", "links", "items"))).alias("p"))
    listed = F.transform("p", lambda x: F.struct(x["metadata"].alias("metadata"), x["links"].alias("links"), x["items"].alias("items")))
    meta = F.struct(F.lit(kind).alias("title"), F.col("number_of_items").alias("numberOfItems"), F.lit(limit or PAGE_DEFAULT).alias("itemsPerPage"), "after", "before")
    return body.join(nav).select(F.to_json(F.struct(meta.alias("metadata"), listed.alias("publications"))).alias("feed"))
