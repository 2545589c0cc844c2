"""Import, delete, look-ups, patterns and feeds on small graphs."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from folioweave.model import ANCHOR, DETAIL, RELATION, TUPLE
from folioweave.operators import ingest, stats
from folioweave.operators import store as S
from folioweave.plans import feed, patterns
from folioweave.streaming import ingest as streaming

NOW = dt.datetime(2024, 5, 1)


def empty(spark):
    return S.GraphStore(*[spark.createDataFrame([], t) for t in (ANCHOR, DETAIL, RELATION)])


def tuples(spark, rows):
    full = []
    for k, r in enumerate(rows):
        own = dict.fromkeys(TUPLE.names) | r | {"input_pos": k}
        full.append(tuple(own[c] for c in TUPLE.names))
    return spark.createDataFrame(full, TUPLE)


def node(kind, key, record=None, source="s", **more):
    return {"kind": kind, "source": source, "key": key, "record": record, **more}


def edge(a, b, relation="item", source="s"):
    return {"kind_from": a[0], "source_from": source, "key_from": a[1], "relation_kind": relation, "kind_to": b[0], "source_to": source, "key_to": b[1]}


@pytest.fixture(scope="module")
def library(spark):
    rows = [node("collection", f"c{k}", f"c{k} v{v}", provider=f"p{v}") for k in range(4) for v in range(2)]
    rows += [node("item", f"i{k}", f"item {k}") for k in range(6)]
    rows += [edge(("collection", f"c{k % 3}"), ("item", f"i{k}")) for k in range(6)] + [edge(("item", "i0"), ("url", "u")), edge(("item", "i1"), ("item", "i1"))]
    new = ingest.upsert(tuples(spark, rows), empty(spark), "p", NOW)
    return S.GraphStore(*[t.cache() for t in (new.anchors, new.details, new.relations)])


def test_import_twice_changes_nothing(spark, library):
    again = tuples(spark, [node("collection ", "C0", "c0 v0", provider="p0"), edge(("Collection", "c0"), ("item", "I0"))])
    batch = ingest.prepare(again, library, "p", NOW)
    assert batch.anchors.count() == batch.details.count() == batch.relations.count() == 0
    assert {(r["class"], r["total"], r["affected"]) for r in batch.report.collect()} == {("anchor", 1, 0), ("detail", 1, 0), ("relation", 1, 0)}


def test_anchor_totals_follow_the_report(spark, library):
    batch = ingest.prepare(tuples(spark, [node("collection", "c0", "new"), node("collection", "c9"), node("collection", "c9"), node("item", None, "x"), {"relation_kind": "r"}]), library, "p", NOW)
    assert {(r["class"], r["kind"], r["total"], r["affected"]) for r in batch.report.collect()} == {("anchor", "collection", 2, 1), ("detail", "collection", 1, 1)}
    assert batch.rejects.count() == 2


def test_first_tuple_of_a_key_wins_and_serials_are_dense(spark, library):
    rows = [node("item", "i9", "same", media_type="a"), node("item", "i9", "same", media_type="b"), node("item", "i9", "same", provider="q", media_type="c"), node("item", "i8", "")]
    new = ingest.upsert(tuples(spark, rows), library, "p", NOW)
    assert {(r.key, r.provider, r.media_type) for r in new.details.collect()} == {("i9", "p", "a"), ("i9", "q", "c"), ("i8", "p", None)}
    most = library.details.agg({"serial": "max"}).first()[0]
    assert sorted(r.serial for r in new.details.collect()) == [most + k for k in (1, 2, 3)]
    assert sorted(r.serial for r in library.anchors.collect()) == list(range(1, library.anchors.count() + 1))


def test_empty_import(spark, library):
    new = ingest.upsert(tuples(spark, []), library, "p", NOW)
    assert new.anchors.count() == new.details.count() == new.relations.count() == 0


def test_pages_walk_all_nodes(spark, library):
    seen, after = [], None
    while page := S.list_kind(library, "collection", after, 3).collect():
        seen += [r.key for r in page]
        after = page[-1].serial
    assert seen == ["c3", "c2", "c1", "c0"]
    assert S.page_size(None) == 100 and S.page_size(0) == 1 and S.page_size(10**6) == 10_000


def test_newest_version_and_limit_first(spark, library):
    newest = S.newest(library.details).where("kind = 'collection'").collect()
    assert len(newest) == 4 and all(r.record.endswith("v1") or r.record.endswith("v0") for r in newest)
    assert S.query_entities(library, limit=3).count() == 3
    assert S.query_entities(library, limit=3, limit_before_dedup=True).count() <= 3


def test_relations_leave_out_loops_and_continue(spark, library):
    nodes = spark.createDataFrame([("item", "S ", "i0"), ("item", "s", "i1")], "kind string, source string, key string")
    both = S.lookup_relations(library, nodes, incoming=True).collect()
    assert {(r.direction, r.kind_from, r.key_to) for r in both} == {("outgoing", "item", "u"), ("incoming", "collection", "i0"), ("incoming", "collection", "i1")}
    assert {(r.key, r.number_of_items) for r in S.degrees(library, nodes, incoming=True).collect()} == {("i0", 2), ("i1", 3)}
    last = max(r.serial for r in both if r.direction == "incoming")
    rest = S.lookup_relations(library, nodes, after=("collection", "item", last), incoming=True).collect()
    assert len(rest) == 2 and S.count_children(library, "s", "i1").first()["n"] == 2


def test_cascading_delete(spark, library):
    left, counts = ingest.cascade(library, "item", "s", "i0")
    assert {r.step: r.n for r in counts.collect()} == {"incoming": 1, "outgoing": 1, "details": 1, "anchors": 1}
    assert left.anchors.count() == library.anchors.count() - 1 and left.relations.count() == library.relations.count() - 2
    loops, counts = ingest.cascade(library, "item")
    assert sum(r.n for r in counts.where("step IN ('incoming', 'outgoing')").collect()) == library.relations.count() and loops.relations.count() == 0


def test_patterns(spark, library):
    n, hop = patterns.Node, patterns.Hop
    assert patterns.match(library, n("collection"), hop(n("item"))).count() == 6
    assert patterns.match(library, n("collection"), hop(), hop(n("url"))).count() == 7
    assert patterns.match(library, n("collection"), hop(), hop(n("url")), prefixes=False).count() == 1
    assert patterns.match(library, n("item"), hop(n("collection"), direction=patterns.IN)).count() == 6
    assert patterns.match(library, n("item"), hop(relations=("other",))).count() == 0
    named = patterns.match(library, n("collection", name="c"), hop(n("item", {"key": "i4"}, "i")), returning=["c.key", "i.serial"])
    assert named.columns == ["c_key", "i_serial"] and [r.c_key for r in named.collect()] == ["c1"]
    assert ("collection", "item", "url") in patterns.kind_paths(library, "collection", 2)


def test_merge_tuples_import(spark):
    n, hop = patterns.Node, patterns.Hop
    made = patterns.merge_tuples(spark, n("book", {"source": "s"}, "b"), hop(n("tag", {"source": "s", "key": "t"}), ("has", "likes"), patterns.BOTH), hop(n("tag", {"source": "s"}, "u")))
    rows = ingest.classify(made.withColumnsRenamed({}).selectExpr("*", "cast(null as string) record"))
    assert {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()} == {"anchor": 3, "relation": 4}


def test_feed_and_navigation(spark, library):
    body = json.loads(feed.kind_feed(library, "item", "https://x.example/", limit=4).first()["feed"])
    assert body["metadata"]["numberOfItems"] == 4 and len(body["publications"]) == 4
    first = feed.kind_feed(library, "item", "https://x.example", after=None, limit=10)
    urls = {p["metadata"]["identifier"]: p for p in json.loads(first.first()["feed"])["publications"]}
    own = urls["https://x.example/resources/item/s/i0"]
    assert own["metadata"]["numberOfItems"] == 1 and [x["rel"] for x in own["links"]] == ["self", "item"]
    nav = feed.navigation(S.list_kind(library, "none"), after=False).first()
    assert nav.number_of_items == 0 and not nav.has_next and nav.after is None


def test_statistics(spark, library):
    daily = stats.daily_details(library.details)
    assert sum(r.cnt for r in daily.collect()) == library.details.count()
    assert stats.rolled_up(daily, ["kind"], since=dt.datetime(2025, 1, 1)).count() == 0
    total = {r.what: (r.groups, r.total) for r in stats.totals(stats.rolled_up(daily, ["kind"]), stats.rolled_up(stats.daily_relations(library.relations), ["kind_from", "kind_to"])).collect()}
    assert total == {"entities": (2, 14), "relations": (3, 8)}


def test_streaming_import_is_idempotent(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for k, name in enumerate(("a", "b")):
        lines = [node("item", "i1", "x"), node("item", f"i{k + 2}", "y"), edge(("item", "i1"), ("item", f"i{k + 2}"))]
        (source / f"{name}.json").write_text("\n".join(json.dumps({c: v for c, v in r.items() if v is not None} | {"input_pos": i}) for i, r in enumerate(lines)))
        streaming.stream_tuples(spark, str(source), path, str(tmp_path / "checkpoint"), "p", NOW).awaitTermination()
    store = streaming.stored(spark, path)
    assert (store.anchors.count(), store.details.count(), store.relations.count()) == (3, 3, 2)
    streaming.import_batch(tuples(spark, [node("item", "i1", "x"), node("item", "i3", "y")]), 1, path, "p", NOW)
    assert sorted(r.key for r in streaming.stored(spark, path).anchors.collect()) == ["i1", "i2", "i3"]


def test_streamed_daily_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 5), "a"), (dt.datetime(2024, 1, 1, 9), "a"), (dt.datetime(2024, 1, 2, 1), "b")]
    spark.createDataFrame(rows, "time_sys timestamp, kind string").write.parquet(str(tmp_path / "in"))
    own = spark.readStream.schema("time_sys timestamp, kind string").parquet(str(tmp_path / "in"))
    for name, out, mode in (("days", streaming.daily_counts(own, "time_sys", ["kind"]), "complete"), ("once", streaming.first_deliveries(own, ["kind"], "time_sys"), "append")):
        out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.kind, r.cnt) for r in spark.table("days").collect()) == [("a", 2), ("b", 1)]
    assert sorted(r.kind for r in spark.table("once").collect()) == ["a", "b"]
