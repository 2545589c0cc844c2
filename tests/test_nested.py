"""Leaf paths, nested headers, merges, byte-true records, serialised bodies, base 58 and the index of vectors."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from folioweave.functions import text, vectors
from folioweave.model import MARC_RECORD
from folioweave.operators import leaves, neighbours
from folioweave.sources import feeds, marc, php, tsv


def rows_of(spark, *docs):
    return spark.createDataFrame(list(enumerate(docs)), "i int, j string")


# Leaf paths


def test_depth(spark):
    docs = ["1", "{}", '{"a":[{"b":1}]}', '{"a":"[[[","b":"\\\\\\"{"}', "[[[]],{}]", None, ""]
    got = [r.d for r in rows_of(spark, *docs).select("i", leaves.depth(F.col("j")).alias("d")).orderBy("i").collect()]
    assert got == [0, 1, 3, 1, 3, None, 0]


def test_leaves(spark):
    own = rows_of(spark, '{"a":{"b":[{"c":"x"},7]},"t":true,"it\'s":null,"o":{},"l":[]}', '{"a":1.5}', "[1]", "oops", None, "null")
    got = {(r.i, ".".join(r.steps), r.place, r.type) for r in leaves.leaves(own, "j", ["i"]).collect()}
    assert got == {
        (0, "a.b.0.c", "$['a']['b'][0]['c']", "STRING"), (0, "a.b.1", "$['a']['b'][1]", "BIGINT"), (0, "t", "$['t']", "BOOLEAN"), (0, "it's", '$["it\'s"]', "VOID"), (0, "o", "$['o']", "OBJECT<>"),
        (1, "a", "$['a']", "DECIMAL(2,1)"), (2, "0", "$[0]", "BIGINT"), (5, "", "$", "VOID"),
    }
    whole = {(r.i, ".".join(r.steps)) for r in leaves.leaves(own, "j", ["i"], arrays=False).collect()}
    assert (0, "a.b") in whole and (0, "l") in whole and (0, "a.b.1") not in whole


def test_nested_tsv_round_trip_of_five_levels(spark, tmp_path):
    docs = [
        {"a": {"b": {"c": {"d": {"e": "deep", "f": ["x", "y"]}}}}, "id": "1"},
        {"id": "2", "list": [{"k": [["p", "q"], ["r"]]}, {"k": [["s"]], "z": "ä \"quoted\""}], "a": {"g": "h"}},
        {"id": "3", "list": [{"z": "\tmany\nlines\r\n"}] + [{"z": str(k)} for k in range(1, 12)]},
    ]
    path = str(tmp_path / "x")
    header = leaves.write_leaf_tsv(rows_of(spark, *map(json.dumps, docs)), "j", path)
    assert header == sorted(header) and {"a.b.c.d.f.1", "list.0.k.0.1", "list.11.z"} <= set(header)
    rows = leaves.nested_records(tsv.read_tsv(spark, path))
    got = {json.loads(r.record)["id"]: json.loads(r.record) for r in rows.collect()}
    docs[2]["list"][0]["z"] = " many lines "
    assert got == {d["id"]: d for d in docs}


def test_headers_with_lists_blanks_and_clashes(spark, tmp_path):
    lines = ["kind\trecord.time.10\trecord.time.2\trecord.a\trecord.a.b\tx\tx\trecord.m.0\trecord.m.k", "k\tten\ttwo\t\tinner\t\tsecond\t0\tv", "k\t \t\tplain\tinner\tfirst\tsecond\t\t", "\t\t\t\t\t\t\t\t "]
    (tmp_path / "a.tsv").write_text("\n".join(lines))
    (tmp_path / "b.tsv").write_text("kind\tother1\tother10\nq\tr\ts")
    got = [None if r.record is None else json.loads(r.record) for r in leaves.nested_records(tsv.read_tsv(spark, str(tmp_path))).orderBy("file", "pos").collect()]
    assert [g for g in got if g] == [
        {"kind": "k", "record": {"time": ["two", "ten"], "a": {"b": "inner"}, "m": {"0": "0", "k": "v"}}, "x": "second"},
        {"kind": "k", "record": {"a": "plain"}, "x": "first"},
        {"kind": "q", "other1": "r", "other10": "s"},
    ]
    assert leaves.nested_records(tsv.read_tsv(spark, str(tmp_path)).limit(0)).count() == 0


def test_nothing_to_write(spark, tmp_path):
    assert leaves.write_leaf_tsv(rows_of(spark, "{}", None, '{"a":null,"b":"","c":[]}'), "j", str(tmp_path / "x")) == []


def merged(spark, rows, order="t"):
    found = leaves.merged_objects(rows, "j", ["g"], order)
    assert found.columns == ["g", "merged"]
    return {r.g: json.loads(r.merged) for r in found.collect()}


def test_merge_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in (1, 2, None):
        sums, words, listed = {}, {}, []
        for t in range(30):
            k, n = rng.choice("abc"), rng.randrange(-50, 50) / 4
            rows.append((g, t, json.dumps({"n": {k: n}, "w": {"x": {k: f"{t} \"q\""}, "b": t % 2 == 0}, "l": [t, {"t": t}], "c": 1})))
            sums[k], words[k] = sums.get(k, 0) + n, f'{t} "q"'
            listed += [t, {"t": t}]
        want[g] = {"n": sums, "w": {"x": words, "b": False}, "l": listed, "c": 30}
    for _ in range(2):
        rng.shuffle(rows)
        assert merged(spark, spark.createDataFrame(rows, "g int, t int, j string").repartition(5)) == want


def test_merge_of_different_kinds(spark):
    rows = [
        (1, 1, '{"n":1,"a":[1,"x"],"s":"p","o":{"q":2,"r":{"w":[true]}},"c":5,"d":"text","z":0}'), (1, 2, '{"n":2.5,"a":[{"z":1}],"s":"b","o":{"q":3,"r":{"w":[false],"e":{}}},"c":{"d":1},"nul":null,"d":4,"z":0.0}'),
        (2, 1, "{}"), (3, 1, "[1]"), (2, 0, '{"b":true,"n":100,"e":{}}'), (4, 1, "{}"), (5, 1, None), (5, 2, "{oops"),
    ]
    got = merged(spark, spark.createDataFrame(rows, "g int, t int, j string"))
    assert got == {1: {"a": [1, "x", {"z": 1}], "c": {"d": 1}, "d": 4, "n": 3.5, "o": {"q": 5, "r": {"e": {}, "w": [True, False]}}, "s": "b", "z": 0}, 2: {"b": True, "e": {}, "n": 100}, 4: {}}
    assert leaves.merged_objects(spark.createDataFrame([], "g int, t int, j string"), "j", ["g"], "t").count() == 0


# Records as bytes


RECORD = {
    "leader": "00000nam a2200000 i 4500", "controlfield": [{"tag": "001", "value": "Нк1"}],
    "datafield": [
        {"tag": "245", "ind1": "0", "ind2": " ", "subfield": [{"code": "a", "value": "Книга Нова №5"}, {"code": "b", "value": "НННН"}]},
        {"tag": "260", "ind1": " ", "ind2": " ", "subfield": [{"code": "b", "value": "дом"}]},
    ],
}


def record_frame(spark, n=3):
    return spark.createDataFrame([(RECORD,)] * n, f"marc {MARC_RECORD.simpleString()}")


@pytest.mark.parametrize("charset", ["UTF-8", "UTF-16LE", "UTF-16BE", "windows-1251", "cp866"])
def test_records_of_any_charset_are_equal(spark, tmp_path, charset):
    own = record_frame(spark).select(marc.to_iso2709(F.col("marc"), charset).alias("t"), "marc")
    if charset == "cp866":
        own = own.withColumn("marc", F.col("marc"))
    raw = [bytes(r.r) for r in own.select(marc.encoded(F.col("t"), charset).alias("r")).collect()]
    (tmp_path / "a.mrc").write_bytes(b"".join(raw))
    wide = charset.startswith("UTF-16")
    got = marc.read_marc(spark, str(tmp_path / "a.mrc"), charset if wide else "UTF-8", None if wide or charset == "UTF-8" else charset).collect()
    assert len(got) == 3 and {r.damage for r in got} == {None}
    for r in got:
        assert r.marc.controlfield[0].value == "Нк1" and r.marc.datafield[0].subfield[1].value == "НННН"
        assert r.marc.datafield[0].subfield[0].value == "Книга Нова №5" and r.marc.datafield[1].subfield[0].value == "дом"
        assert int(r.marc.leader[:5]) == len(raw[0])


def test_a_file_of_two_schemes(spark, tmp_path):
    both = [bytes(record_frame(spark, 1).select(marc.encoded(marc.to_iso2709(F.col("marc"), c), c).alias("r")).first().r) for c in ("UTF-8", "windows-1251")]
    (tmp_path / "a.mrc").write_bytes(b"".join(both))
    got = marc.read_marc(spark, str(tmp_path / "a.mrc"), other="windows-1251").collect()
    assert [r.marc.datafield[0].subfield[0].value for r in got] == ["Книга Нова №5"] * 2 and [r.damage for r in got] == [None, None]


def test_damaged_records_are_rejects(spark):
    iso = bytes(record_frame(spark, 1).select(marc.encoded(marc.to_iso2709(F.col("marc"))).alias("r")).first().r)
    cases = [
        (iso, None), (iso[:-1], None), (iso[:-9], "length"), (b"", "length"), (None, "length"), (b"x" * 40, "length"), (iso[:12] + b"0x000" + iso[17:], "base"), (iso[:12] + b"99999" + iso[17:], "base"),
        (iso[:12] + b"00062" + iso[17:], "directory"), (iso[:27] + b"a" + iso[28:], "directory"), (iso[:31] + b"9" + iso[32:], "field"), (iso[:70] + b"\xff\xfe" + iso[72:], None),
    ]
    got = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, r binary").select("k", marc.damage(F.col("r")).alias("d"), marc.parsed(F.col("r")).alias("m")).orderBy("k").collect()
    assert [r.d for r in got] == [d for _, d in cases]
    assert got[-1].m is not None and got[6].m is None


# Serialised bodies


def serialised(v):
    if v is None:
        return "N;"
    if isinstance(v, bool):
        return f"b:{int(v)};"
    if isinstance(v, int):
        return f"i:{v};"
    if isinstance(v, float):
        return f"d:{v};"
    if isinstance(v, str):
        return f's:{len(v.encode())}:"{v}";'
    return f"a:{len(v)}:{{" + "".join(serialised(k) + serialised(x) for k, x in v.items()) + "}"


def flat(v, path=()):
    if isinstance(v, dict):
        return [y for k, x in v.items() for y in flat(x, (*path, str(k)))]
    kind = "N" if v is None else {bool: "b", int: "i", float: "d", str: "s"}[type(v)]
    return [(list(path), kind, None if v is None else str(int(v)) if isinstance(v, bool) else str(v))]


def test_serialised_values(spark):
    values = [{"a": {0: 'Привет "мир"; {}', 1: {"x": {"y": 1.5, "z": None, "w": True}}}, "b": -3, "": "", "e": {}}, "top", 7, None, {}, {0: {0: {}}, "k": 's:1:"x";'}, {"p": "я" * 300 + '";}'}]
    broken = ['a:1:{i:0;s:5:"ab";}', "xx", serialised(values[0]) + "!", "a:1:{i:0;", None, "", "}", 's:3:"ab";', "a:1:{d:1.5;i:0;}", "i:1;i:2;"]
    texts = [serialised(v) for v in values] + broken + ['O:8:"stdClass":1:{s:1:"p";i:4;}']
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", php.leaves(F.col("t")).alias("x")).orderBy("k").collect()]
    assert [[tuple(x) for x in g] for g in got[: len(values)]] == [flat(v) for v in values]
    assert got[len(values) : -1] == [None] * len(broken) and [tuple(x) for x in got[-1]] == [(["p"], "i", "4")]


def test_paragraphs_of_articles(spark, tmp_path):
    from urllib.parse import quote_plus

    body = quote_plus(serialised({0: {"text": "Что собой", "footnotes": {0: {"text": "сноска"}}}, 1: {"text": "и далее"}}))
    xml = f"<journals><journal><issn>1</issn><title>T%20x</title><issues><issue><product_id>p</product_id><articles><article><external_pid>a</external_pid><title>q</title><text>{body}</text></article></articles></issue></issues></journal></journals>"
    for encoding in ("UTF-8", "UTF-16"):
        (tmp_path / "j.xml").write_bytes(xml.encode(encoding))
        r = feeds.read_journals(spark, str(tmp_path / "j.xml"), encoding).first()
        assert r.title == "T x" and r.issues[0].articles[0].paragraphs == ["Что собой", "сноска", "и далее"]


# Base 58


def test_base58(spark):
    rng = random.Random(1)
    raw = [rng.randbytes(rng.choice([0, 1, 2, 8, 16, 32])) for _ in range(60)] + [b"\0\0\1", b"\0", b"\xff" * 16, None]

    def brute(b):
        n, out = int.from_bytes(b, "big"), ""
        while n:
            n, digit = divmod(n, 58)
            out = text.BASE58[digit] + out
        return out

    got = [r.b for r in spark.createDataFrame(list(enumerate(raw)), "k int, x binary").select("k", text.base58(F.col("x")).alias("b")).orderBy("k").collect()]
    assert got == [None if b is None else brute(b) for b in raw]
    numbers = spark.createDataFrame([(n,) for n in (0, 57, 58, 2**62, -1, None)], "n long").select(text.base58_number(F.col("n")).alias("b"))
    assert [r.b for r in numbers.collect()] == ["", "Z", "21", brute((2**62).to_bytes(8, "big")), None, None]


# Vectors


def test_index_finds_most_neighbours(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = rows.where("vec_id % 100 = 0")
    index = neighbours.VectorIndex.build(rows, str(tmp_path / "x"), lists=16)
    exact = neighbours.exact_neighbours(rows, asked, 10, block=2)
    assert neighbours.recall(index.search(asked, 10, 11), exact).first().recall >= 0.9
    whole = neighbours.recall(index.search(asked, 10, 16), exact).first()
    assert whole.recall == 1.0 and (whole.queries, whole.neighbours) == (5, 50)
    again = neighbours.VectorIndex(spark, str(tmp_path / "x")).search(asked, 3, 16).collect()
    assert {(r["query"], r["id"]) for r in again if r["rank"] == 0} == {(r.vec_id, r.vec_id) for r in asked.collect()}


def test_index_leaves_out_what_has_no_direction(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [3.0, 0.1]), (7, [None, 1.0]), (None, [1.0, 1.0])]
    own = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, list string")
    index = neighbours.VectorIndex.build(own, str(tmp_path / "x"), lists=2)
    got = index.search(own.where("vec_id IN (1, 3, 5)"), 2, 2).orderBy("rank").collect()
    assert [(r["query"], r["id"]) for r in got] == [(1, 1), (1, 6)]


def test_norms_and_unit_sums(spark):
    rows = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [0.0, 0.0]), ("a", [0.0, 5.0]), ("b", [1e200, 0.0])], "g string, v array<double>")
    assert [r.n for r in rows.select(vectors.l2norm(F.col("v")).alias("n")).collect()] == [5.0, 0.0, 5.0, 1e200]
    got = {r.g: r.vector for r in vectors.unit_sum(rows, ["g"], "v").collect()}
    assert got["b"] == [1.0, 0.0] and got["a"] == pytest.approx([0.6 / (0.36 + 3.24) ** 0.5, 1.8 / (0.36 + 3.24) ** 0.5])
