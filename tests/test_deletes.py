"""Linking entries, daily counts that heed deletions, and deletes on stored tables."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from folioweave.functions import marc
from folioweave.model import MARC_RECORD
from folioweave.operators import ingest, stats, stored
from folioweave.operators import store as S
from folioweave.plans import linking
from folioweave.sources import marc as marc_source
from folioweave.streaming import ingest as streaming
from tests.test_graph import edge, node, tuples

NOW = dt.datetime(2024, 5, 1)


def field(tag, ind2, *subs):
    return {"tag": tag, "ind1": "0", "ind2": ind2, "subfield": [{"code": c, "value": v} for c, v in subs]}


def records(spark, *fields, key="r1", source="LibA"):
    rec = {"leader": "00000nam a2200000 i 4500", "controlfield": [{"tag": "001", "value": key}, {"tag": "003", "value": source}], "datafield": list(fields)}
    return spark.createDataFrame([(rec, 3)], f"marc {MARC_RECORD.simpleString()}, pos long")


def test_linking_entries(spark):
    own = records(
        spark, field("780", "7", ("w", "(NLR) N 1")), field("780", "9", ("w", "k9"), ("w", "K10")), field("785", None, ("w", "k11")), field("787", " ", ("t", "no number")),
        field("773", "0", ("w", "  "), ("w", None)), field("774", "0", ("w", "(RuMoEDL)(RuMoEDL) 5")), field("776", "0", ("w", "no rule")),
    )
    got = sorted((r.relation_kind, r.kind_to, r.source_to, r.key_to) for r in linking.linking_edges(own).collect())
    assert got == [
        ("hasPart", "instance", "rumoedl", "(rumoedl) 5"), ("precededBy", "instance", "liba", "k10"), ("precededBy", "instance", "liba", "k9"),
        ("separatedFrom", "instance", "rusprnb", "n 1"), ("succeededBy", "instance", "liba", "k11"),
    ]
    assert linking.linking_edges(records(spark, field("780", "0", ("w", "x")), source="")).count() == 0
    mine = linking.linking_edges(own, (("787", None, "x"), ("780", "9", "own")))
    assert {r.relation_kind for r in mine.collect()} == {"own"}


def test_targets_among_the_anchors(spark):
    edges = linking.linking_edges(records(spark, *[field("780", "0", ("w", k)) for k in "abc"]))
    anchors = spark.createDataFrame([("item", "liba", "a"), ("instance", "liba", "a"), ("url", "liba", "b"), ("item", "liba", "b"), ("item", "other", "c"), ("item", "liba", "b")], "kind string, source string, key string")
    assert {r.key_to: (r.kind_to, r.found) for r in linking.resolved(edges, anchors).collect()} == {"a": ("instance", True), "b": ("item", True), "c": ("instance", False)}
    assert [tuple(r) for r in linking.unresolved(edges, anchors).collect()] == [("continues", "liba", 1, 1)]
    assert linking.resolved(edges, anchors.limit(0)).where("found").count() == 0


def test_linking_entries_are_imported(spark):
    own = records(spark, field("775", "0", ("w", "r2"))).withColumns({"record": F.lit("x"), "media_type": F.lit("application/marc")})
    rows = ingest.classify(ingest.normalise(marc_source.tuples(own)))
    assert sorted((r["class"], r.relation_kind, r.key_to) for r in rows.collect()) == [("detail", None, None), ("relation", "otherEdition", "r2")]
    assert marc_source.tuples(own, linking=False).count() == 1


def test_codes_of_libraries(spark):
    got = spark.createDataFrame([(c,) for c in ("RuMoRGB", " ELAR", "НЛР", "ргб", "07NLR", None)], "c string").select(marc.source_code(F.col("c")).alias("s"))
    assert [r.s for r in got.collect()] == ["RuMoRGB", "RuMoRGB", "НЛР", "RuSpRNB", "RuSpRNB", None]


def library(spark, days=3):
    rows = []
    for k in range(6):
        rows += [node("book", f"b{k}", f"text {k}"), node("item", f"i{k}", "copy"), edge(("book", f"b{k}"), ("item", f"i{k}")), edge(("book", f"b{k}"), ("book", f"b{(k + 1) % 6}"), "next")]
    return tuples(spark, rows)


def counted(pair):
    return [sorted(map(tuple, rows.collect()), key=str) for rows in pair]


def recount(store):
    return [stats.daily_details(store.details), stats.daily_relations(store.relations)]


def test_ledger_equals_a_recount(spark, tmp_path):
    empty = S.GraphStore(*[spark.createDataFrame([], t) for t in streaming._TABLES.values()])
    store = ingest.upsert(library(spark), empty, "p", NOW)
    ledger = stats.Ledger(spark, str(tmp_path / "ledger"))
    assert counted(ledger.daily()) == [[], []]
    ledger.record(0, added=store)
    assert counted(ledger.daily()) == counted(recount(store))
    left, _ = ingest.cascade(store, "book", "s", "b2")
    ledger.record(1, removed=ingest.removal(store, "book", "s", "b2"))
    ledger.record(1, removed=ingest.removal(store, "book", "s", "b2"))
    assert counted(ledger.daily()) == counted(recount(left)) and ledger.recorded(1) and not ledger.recorded(2)
    ledger.compact(1)
    assert counted(ledger.daily()) == counted(recount(left))
    with pytest.raises(ValueError, match="settled"):
        ledger.record(1, added=store)
    again = ingest.upsert(library(spark), left, "p", NOW + dt.timedelta(days=1))
    ledger.record(2, added=again)
    whole = ingest.appended(left, again)
    assert counted(ledger.daily()) == counted(recount(whole))
    ledger.compact(2)
    assert counted(ledger.daily()) == counted(recount(whole))
    # A sum that wasn't finished isn't read.
    os.remove(tmp_path / "ledger" / "sums" / "batch=2" / "relations" / "_SUCCESS")
    assert counted(ledger.daily()) == counted(recount(whole))


def test_streamed_deletes(spark, tmp_path):
    path = str(tmp_path / "store")
    streaming.import_batch(library(spark), 0, path, "p", NOW)
    first = streaming.stored(spark, path)
    before = {n: getattr(first, n).count() for n in ("anchors", "details", "relations")}
    assert before == {"anchors": 12, "details": 12, "relations": 12}
    for _ in range(2):
        streaming.delete_batch(spark, 1, path, "book", "s", "b2")
        store = streaming.stored(spark, path)
        # Its edge to the copy, to the next book and from the one before.
        assert (store.anchors.count(), store.details.count(), store.relations.count()) == (11, 11, 9)
        assert counted(streaming.counts(spark, path).daily()) == counted(recount(store))
    streaming.import_batch(library(spark), 2, path, "p", NOW + dt.timedelta(days=2))
    store = streaming.stored(spark, path)
    assert {n: getattr(store, n).count() for n in before} == before
    assert counted(streaming.counts(spark, path).daily()) == counted(recount(store))
    for n in before:
        serials = [r.serial for r in getattr(store, n).collect()]
        assert len(set(serials)) == len(serials) and max(serials) > before[n]
    streaming.delete_batch(spark, 3, path, "item")
    store = streaming.stored(spark, path)
    assert {r.kind for r in store.anchors.collect()} == {"book"} and store.relations.count() == 6
    assert counted(streaming.counts(spark, path).daily()) == counted(recount(store))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_delete_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    empty = S.GraphStore(*[spark.createDataFrame([], t) for t in streaming._TABLES.values()])
    more = tuples(spark, [node("a b/c", "x", "odd kind"), edge(("a b/c", "x"), ("item", "i0"))])
    store = ingest.upsert(library(spark).unionByName(more), empty, "p", NOW)
    store.write(path)
    old = files(path)
    ledger = stats.Ledger(spark, str(tmp_path / "ledger"))
    ledger.record(0, added=store)
    done = stored.delete_stored(spark, path, "book", "s", "b2", ledger, 1)
    assert done == {"relations": 2, "details": 1, "anchors": 1}
    new = files(path)
    same = {f for f in old if new.get(f) == old[f]}
    assert same and all("kind=item" in f or "kind=a b" in f or "kind_from=a b" in f for f in same) and {f for f in old if "kind=item" in f} <= same
    want, _ = ingest.cascade(store, "book", "s", "b2")
    read = S.GraphStore.read(spark, path)
    for name in ("anchors", "details", "relations"):
        got, expected = (sorted(str(sorted(r.asDict().items())) for r in getattr(s, name).collect()) for s in (read, want))
        assert got == expected
    assert counted(ledger.daily()) == counted(recount(want))
    # A kind that loses all of its rows, with a name that its folder escapes; a delete that runs again; one of nothing.
    assert stored.delete_stored(spark, path, "a b/c") == {"relations": 1, "details": 1, "anchors": 1}
    assert stored.delete_stored(spark, path, "a b/c", ledger=ledger, number=1) == {"relations": 0, "details": 0, "anchors": 0}
    assert S.GraphStore.read(spark, path).anchors.where("kind = 'a b/c'").isEmpty() and counted(ledger.daily()) == counted(recount(want))
    assert stored.delete_stored(spark, path, "none") == {"relations": 0, "details": 0, "anchors": 0}
