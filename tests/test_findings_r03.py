"""Cases of the third round's findings: whole results over several documents, and work that is done once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


@pytest.fixture()
def customers(spark, tmp_path):
    k = F.col("id")
    rows = spark.range(0, 9000, 1, 2).select(k.alias("c_custkey"), F.concat(F.lit("Customer#"), k.cast("string")).alias("c_name"), F.lit("FURNITURE").alias("c_mktsegment"), (k % 25).cast("int").alias("c_nationkey"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


@pytest.fixture()
def parts(spark, tmp_path):
    k = F.col("id")
    rows = spark.range(0, 9000, 1, 2).select(k.alias("p_partkey"), F.concat(F.lit("part "), k.cast("string")).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("LARGE").alias("p_type"), (k % 50 + 1).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", ["atom_entries", "atom_publications", "publishers_books"])
def test_all_documents_of_customers_are_read(spark, customers, query):
    found = entry.queries()[query](spark, customers)
    assert found.count() == found.distinct().count() == 9000


@pytest.mark.parametrize("query", ["marcxml_round_trip", "onix_publications"])
def test_all_documents_of_parts_are_read(spark, parts, query):
    found = entry.queries()[query](spark, parts)
    assert found.count() == found.distinct().count() == 9000


def test_bodies_of_several_issues_stay_with_their_articles(spark, tmp_path):
    from urllib.parse import quote_plus

    from folioweave.sources import feeds

    one = lambda k: f"<article><external_pid>a{k}</external_pid><title>t</title>" + ("" if k == 2 else f"<text>{quote_plus(f'a:1:{{i:0;a:1:{{s:4:"text";s:2:"w{k}";}}}}')}</text>") + "</article>"
    issue = lambda p, *ks: f"<issue><product_id>{p}</product_id>" + (f"<articles>{''.join(map(one, ks))}</articles>" if ks else "") + "</issue>"
    (tmp_path / "j.xml").write_text(f"<journals><journal><issn>1</issn><title>x</title><issues>{issue('p', 1, 2)}{issue('q')}{issue('r', 3, 4)}</issues></journal></journals>")
    found = feeds.read_journals(spark, str(tmp_path / "j.xml")).first().issues
    assert [(i.product_id, i.articles and [(a.external_pid, a.paragraphs) for a in i.articles]) for i in found] == [
        ("p", [("a1", ["w1"]), ("a2", None)]), ("q", None), ("r", [("a3", ["w3"]), ("a4", ["w4"])])]


def test_serialised_values_take_time_in_proportion(spark):
    import time

    from folioweave.sources import php

    def took(n):
        text = f"a:{n}:{{" + "".join(f'i:{k};s:4:"abcd";' for k in range(n)) + "}"
        rows = spark.createDataFrame([(text,)] * 2, "t string").select(F.size(php.leaves(F.url_decode(F.url_encode("t")))).alias("n"))
        began = time.time()
        assert [r.n for r in rows.collect()] == [n, n]
        return time.time() - began

    took(10)
    assert took(30_000) < 20


def test_pipeline_keeps_one_of_each_group_of_fingerprints(spark):
    import random

    import corpus_pipeline
    from tests.llm.test_exact_ops import brute_components, brute_fingerprint

    rng = random.Random(5)
    texts = ["", None, "one", "one"]
    for _ in range(6):
        base = [f"w{rng.randrange(900)}" for _ in range(300)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(900)}"
            texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    group = brute_components([brute_fingerprint(t or "") for t in texts])
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert kept == [k for k in ids if group[k] == k] and 10 < len(kept) < len(ids)


def test_documents_of_null_and_repeated_ids_are_told_apart_by_text(spark):
    from folioweave.llm import simhash

    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s"), (None, "q r s"), (2, "x y z w"), (2, "quite another text of this id"), (3, "x y z w")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "a b c d"), (None, "q r s"), (2, "x y z w"), (2, "quite another text of this id")], key=str)


def times_in_plan(column, mark):
    return column._jc.toString().count(mark)


def test_a_record_is_worked_out_once(spark):
    from folioweave.functions import marc as M
    from folioweave.model import MARC_RECORD
    from folioweave.plans import convert
    from folioweave.sources import marc

    text = F.concat("t", F.lit("MARK"))
    record = F.from_json(text, MARC_RECORD.simpleString())
    for column in (marc.damage(text), marc.parsed(text), marc.to_iso2709(record), marc.to_slim_xml(record), M.dates(record), convert.either_marc(record), convert.marc21_to_opds(record)):
        assert times_in_plan(column, "MARK") == 1


def test_numbers_in_base_58_need_no_lists(spark):
    from folioweave.functions import text

    rows = spark.createDataFrame([(n,) for n in (0, 1, 57, 58, 58**10 - 1, 58**10, 2**63 - 1, -1, None)], "t long")
    assert "aggregate(" not in text.base58_number(F.col("t"))._jc.toString()
    octets = F.unhex(F.lpad(F.hex("t"), 16, "0"))
    for r in rows.select("t", text.base58_number(F.col("t")).alias("a"), text.base58(octets).alias("b")).collect():
        assert r.a == (r.b if r.t is not None and r.t >= 0 else None)


def test_a_merge_reads_its_rows_once(spark):
    from folioweave.operators import leaves

    rows = spark.createDataFrame([(1, k, '{"a":{"b":{"c":{"d":1,"e":[1]}}},"x":"y"}') for k in range(3)], "g int, o int, j string")
    merged = leaves.merged_objects(rows, "j", ["g"], "o")
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert merged.first()["merged"] == '{"a":{"b":{"c":{"d":3,"e":[1,1,1]}}},"x":"y"}'


def test_islands_take_one_sort_and_no_hashing(spark):
    from folioweave.functions import ranges

    given = [("a", k) for k in (5, 5, 6, 9, 1, None, None, 10, 10, 12)] + [("b", None), ("c", -1), ("c", 0), ("c", 0)]
    found = ranges.islands(spark.createDataFrame(given, "g string, k int"), ["g"], "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Sort [") == plan.count("Exchange ") == 1, plan
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", None, None, 1), ("a", 1, 1, 1), ("a", 5, 6, 2), ("a", 9, 10, 2), ("a", 12, 12, 1), ("b", None, None, 1), ("c", -1, 0, 2)], key=str)


# Neighbours


def ranked_by_hand(units, asked, most):
    """(query, rank, id, distance) of the nearest of ``units``, rows (id, v), added up component by component; ids that are null come first."""
    out = []
    for query, q in asked:
        all_of = []
        for i, v in units:
            s = 0.0
            for x, y in zip(v, q):
                s += x * y
            all_of.append((1 - s, (i is not None, i or 0), i))
        out += [(query, rank, i, d) for rank, (d, _, i) in enumerate(sorted(all_of, key=lambda r: r[:2])[:most])]
    return sorted(out, key=lambda r: r[:2])


def tied_vectors():
    """Copies, vectors of equal distance from many others, and others; ids in another order than rows, one of them null."""
    import random

    rng = random.Random(3)
    axes = [[s * float(k == n) for k in range(8)] for n in range(8) for s in (1, -1)]
    rows = axes * 4 + [[1.0, 1.0] + [0.0] * 6] * 30 + [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(200)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(None if i == 7 else i, v) for i, v in zip(ids, rows)]


@pytest.mark.parametrize("most", [1, 10, 100])
def test_all_lists_of_many_parts_hold_the_exact_neighbours(spark, tmp_path, monkeypatch, most):
    from folioweave.operators import neighbours

    # Parts of 20 vectors, blocks of 4 queries or fewer.
    monkeypatch.setattr(neighbours, "PART", 8 * 20)
    monkeypatch.setattr(neighbours, "BLOCK", 8 * 4)
    rows = spark.createDataFrame(tied_vectors(), "vec_id long, embedding array<double>")
    index = neighbours.VectorIndex.build(rows, str(tmp_path / "x"), lists=6)
    units = [(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "x/lists")).select("id", "v").collect()]
    assert len(units) == rows.count()
    asked = rows.where("vec_id % 20 = 0")
    want = ranked_by_hand(units, [(i, v) for i, v in units if i is not None and i % 20 == 0], most)
    for found in (index.search(asked, most, 6), neighbours.exact_neighbours(rows, asked, most, block=3)):
        assert sorted(((r["query"], r["rank"], r["id"], r["distance"]) for r in found.collect()), key=lambda r: r[:2]) == want


def test_many_ties_are_trimmed_on_the_way(monkeypatch):
    import numpy as np

    from folioweave.operators import neighbours

    monkeypatch.setattr(neighbours, "TOGETHER", 16)
    units = [(i or 0, v) for i, v in tied_vectors()[:90]]
    units = [(i, [x / sum(y * y for y in v) ** 0.5 for x in v]) for i, v in units]
    v, ids = np.array([v for _, v in units]), np.array([i for i, _ in units])
    lists, asked = np.arange(90) % 3, np.array([0, 2] * 5)
    i, j, d = neighbours._best(v, lists, ids, v[:5], np.repeat(np.arange(5), 2), asked, 4)
    own = [u for u, n in zip(units, lists) if n != 1]
    want = ranked_by_hand(own, [(k, v[k].tolist()) for k in range(5)], 4)
    assert list(zip(i.tolist(), ids[j].tolist(), d.tolist())) == [(k, found, distance) for k, _, found, distance in want]


@pytest.mark.parametrize("lists, every", [(4, 20), (2, 10)])
def test_neighbours_of_many_queries_take_products_of_matrices(spark, tmp_path, lists, every):
    """Twenty million pairs took longer than this as sums of lists' elements."""
    import time

    from folioweave.operators import neighbours

    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.xxhash64("id", k) / 2.0**63).alias("embedding"))
    rows.write.parquet(str(tmp_path / "e"))
    rows = spark.read.parquet(str(tmp_path / "e"))
    index = neighbours.VectorIndex.build(rows, str(tmp_path / "x"), lists=4, sample=2000)
    index.search(rows.where("vec_id = 0"), 10, lists).count()
    began = time.time()
    found = index.search(rows.where(F.col("vec_id") % every == 0), 10, lists)
    assert found.where("rank = 0 AND query = id").count() == 20_000 // every
    assert time.time() - began < 25


def test_half_of_the_lists_hold_their_exact_neighbours(spark, tmp_path, monkeypatch):
    from folioweave.operators import neighbours

    monkeypatch.setattr(neighbours, "PART", 8 * 20)
    monkeypatch.setattr(neighbours, "BLOCK", 8 * 4)
    rows = spark.createDataFrame(tied_vectors()[-200:], "vec_id long, embedding array<double>").where("vec_id IS NOT NULL")
    index = neighbours.VectorIndex.build(rows, str(tmp_path / "x"), lists=8)
    units = spark.read.parquet(str(tmp_path / "x/lists")).collect()
    centroids = {r["list"]: r["c"] for r in spark.read.parquet(str(tmp_path / "x/centroids")).collect()}
    want = []
    for u in units:
        if u.id % 10 == 0:
            near = sorted(centroids, key=lambda k: sum((x - y) ** 2 for x, y in zip(u.v, centroids[k])))[:4]
            want += ranked_by_hand([(o.id, o.v) for o in units if o["list"] in near], [(u.id, u.v)], 10)
    found = index.search(rows.where("vec_id % 10 = 0"), 10, 4).collect()
    assert sorted((r["query"], r["rank"], r["id"], r["distance"]) for r in found) == sorted(want) and len({w[0] for w in want}) > 10


def test_equal_vectors_take_no_pair_each(monkeypatch):
    """Twenty-five million pairs of equal distance took longer than this; one of two lists has a copy that is least by the order."""
    import time

    import numpy as np

    from folioweave.operators import neighbours

    n = 10_000
    v = np.full((n, 64), 0.125)
    v[::100] = np.eye(64)[0]
    lists, order = np.zeros(n, int), np.arange(n)[::-1].copy()
    lists[-1] = 1
    asked = np.tile([0, 1], 2500)
    began = time.time()
    i, j, d = neighbours._best(v, lists, order, v[1:2].repeat(2500, 0), np.arange(2500).repeat(2), asked, 10)
    assert time.time() - began < 8
    assert i.tolist() == np.arange(2500).repeat(10).tolist() and j.tolist() == list(range(n - 1, n - 11, -1)) * 2500 and set(d.tolist()) == {0.0}


def test_tasks_grow_with_the_cells(spark, tmp_path, monkeypatch):
    from folioweave.operators import neighbours

    monkeypatch.setattr(neighbours, "PART", 8 * 10)
    monkeypatch.setattr(neighbours, "BLOCK", 8 * 5)
    rows = spark.createDataFrame(tied_vectors(), "vec_id long, embedding array<double>")
    index = neighbours.VectorIndex.build(rows, str(tmp_path / "x"), lists=6)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("cells", "cells")
    try:
        assert index.search(rows.where("vec_id % 20 = 0"), 5, 3).count() == 5 * rows.where("vec_id % 20 = 0").count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup("cells") for s in tracker.getJobInfo(job).stageIds]
    # Thirty parts or so, four blocks; the session has 4 shuffle partitions.
    assert max(s.numTasks for s in stages if s) >= 100
