"""Readers, writers, accessors, dates and conversion on records written here."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folioweave.functions import dates, marc, ranges, text, vectors
from folioweave.model import MARC_RECORD
from folioweave.plans import convert
from folioweave.sources import feeds, quads, registry, tsv
from folioweave.sources import marc as marc_source

LEADER = "00000nam a2200000 i 4500"


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("given", "want"), [
    ("skos:ConceptScheme", "concept_scheme"), ("Book", "book"), ("http://x#Some Thing", "some_thing"), ("__a--b__", "a_b"), ("ж", None), ("", None), (None, None),
])
def test_sanitize_kind(spark, given, want):
    assert one(spark, text.sanitize_kind(F.col("v")), given) == want


@pytest.mark.parametrize(("given", "want"), [
    ("/Kind/Src/a b/C", "/resources/kind/src/a%20b%2Fc"), ("/resources/k/s/x", "/resources/k/s/x"), ("plain", "plain"),
])
def test_sanitize_key(spark, given, want):
    assert one(spark, text.sanitize_key(F.col("v")), given) == want


@pytest.mark.parametrize(("given", "want"), [
    ("(SRC)key", ("SRC", "key")), ("(A)(B) x1", ("A", "x1")), ("(A#B)k#2", ("A B", "k 2")), ("http://host/a/b", ("host", "a/b")), ("src/key", ("src", "key")), ("word", None), ("", None), (None, None),
])
def test_parse_identifier(spark, given, want):
    got = one(spark, text.parse_identifier(F.col("v")), given)
    assert (got and tuple(got)) == want


def test_small_functions(spark):
    assert one(spark, text.tokenized(F.col("v")), "<b>Hi</b>, you!") == "Hi , you !"
    assert one(spark, text.length_in_bytes(F.col("v")), "aж") == 3
    assert one(spark, text.escaped_unprintable(F.col("v")), "a\n\tb") == "a\\n\\tb"
    assert one(spark, text.uuid_text(F.md5("v")), "x").count("-") == 4
    assert one(spark, text.pretty_bytes(F.col("v")), 1_500_000, "long") == "1.5 MB"
    assert one(spark, text.record_url("http://b/", F.lit("k"), F.lit("s"), F.col("v")), "a/b") == "http://b/resources/k/s/a%2Fb"
    assert one(spark, text.record_url("http://b/", F.lit("k"), F.lit("s"), F.col("v")), "http://z/") == "http://z/"
    assert one(spark, text.joined_uri(F.col("v"), F.lit("/b/"), F.lit("c")), "http://a/") == "http://a/b/c"
    assert tuple(one(spark, text.decode_cursor(F.col("v")), "Item-url-12")) == (["item", "url"], 12)
    assert one(spark, text.decode_cursor(F.col("v")), "12") is None
    assert tuple(one(spark, text.uri_to_node(F.col("v"), {"http://udc.example/": "udc"}), "http://udc.example/A#b")) == ("concept", "udc", "a#b")
    assert one(spark, dates.minutes_text(F.col("v")), 65_000, "long") == "1:05"
    links = one(spark, text.sorted_links(F.array(*[F.struct(F.lit(r).alias("rel"), F.lit("h").alias("href"), F.lit("t").alias("title")) for r in ("x", "convertedFrom", "self", "first")])))
    assert [x["rel"] for x in links] == ["self", "first", "x", "convertedFrom"]


@pytest.mark.parametrize(("given", "lower", "want"), [
    ("19940223151047.0", False, dt.datetime(1994, 2, 23, 15, 10, 47)), ("20010203", False, dt.datetime(2001, 2, 3)), ("201012uu", False, dt.datetime(2010, 12, 1)),
    ("2010uuuu", False, dt.datetime(2010, 1, 1)), ("710203", False, dt.datetime(1971, 2, 3)), ("700203", False, dt.datetime(2070, 2, 3)), ("19--", True, dt.datetime(1900, 1, 1)),
    ("19??", False, dt.datetime(1999, 12, 31)), ("c1984.", True, dt.datetime(1984, 1, 1)), ("c1984.", False, dt.datetime(1984, 12, 31)), ("00000000", False, None), ("nothing", False, None), (None, False, None),
])
def test_parse_date(spark, given, lower, want):
    assert one(spark, dates.parse_date(F.col("v"), lower), given) == want


def test_coded_dates(spark):
    day = lambda y, m=1, d=1: dt.datetime(y, m, d)
    got = lambda code, digits: one(spark, dates.coded_dates(F.lit(code), F.col("v")), digits).asDict()
    assert got("d", "19901999")["date_end"] == day(1999, 12, 31) and got("s", "1990    ")["date_start"] == day(1990)
    assert got("m", "19901995")["date2_start"] == day(1995) and got("r", "20001950")["reissue_end"] == day(1950, 12, 31)
    p = got("p", "19991985")
    assert p["date_production"] == day(1985) and p["date_distribution"] == day(1999, 12, 31)
    assert got("b", "        ")["other_field"] == "046" and not any(got("n", "19901999").values())


@pytest.mark.parametrize(("given", "most", "longest", "want"), [
    ("1-5,7,3", None, None, [(1, 5), (7, 7)]), ("5..3,1...3", None, None, [(1, 5)]), ("-2", 10, None, [(9, 9)]), ("", 3, None, [(1, 3)]), ("1-7", None, 3, [(1, 3), (4, 6), (7, 7)]),
    ("x,2", None, None, [(2, 2)]), ("9-12", 10, None, [(9, 10)]), (None, None, None, []),
])
def test_ranges(spark, given, most, longest, want):
    got = one(spark, ranges.runs(ranges.range_numbers(F.col("v"), most), longest), given)
    assert [tuple(r) for r in got] == want


def test_time_ranges_and_epochs(spark):
    bounds = dates.parse_range(F.col("v"))
    assert tuple(one(spark, bounds, '["2020-01-01 00:00:00",)')) == (dt.datetime(2020, 1, 1), None)
    assert one(spark, dates.in_range(F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz"), bounds), "[2020-01-01,2020-01-01)") is False
    seconds = one(spark, dates.epoch_time(F.col("v")).cast("string"), 86_400, "long")
    assert seconds == "1970-01-02 00:00:00" and one(spark, dates.epoch_time(F.col("v")).cast("string"), 86_400_000_000, "long").startswith("1972")


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [])], "vec_id int, embedding array<float>")
    assert [r.n for r in rows.select(vectors.l2norm(F.col("embedding")).alias("n")).collect()] == [5.0, 2.0, 0.0, 0.0]
    total = vectors.unit_sum(rows.where("vec_id < 4").withColumn("g", F.lit(1)), ["g"], "embedding").first()["vector"]
    assert total == pytest.approx([0.6 / 3.6**0.5 * 1.0, 1.8 / 3.6**0.5], abs=1e-6)
    near = vectors.nearest(rows.where("vec_id < 4"), [0.0, 1.0], 2).collect()
    assert [(r.vec_id, r["rank"]) for r in near] == [(2, 0), (1, 1)]
    assert one(spark, vectors.l2norm(F.array(F.lit(1e200), F.lit(1e200)))) == pytest.approx(1.41421356e200)


def record(control=(), data=(), leader=LEADER):
    return (leader, [tuple(c) for c in control], [(t, i[0], i[1], [tuple(s) for s in subs]) for t, i, subs in data])


BOOK = record(
    [("001", "RU/42"), ("003", "LIB"), ("005", "20200102030405.0"), ("008", "010203s1999    ru            000 0 eng  ")],
    [
        ("100", "1 ", [("a", "Doe, J."), ("d", "1950-2010")]), ("245", "10", [("a", "A title : rest"), ("b", "sub & <title>")]), ("260", "  ", [("b", "Pub"), ("c", "1999")]), ("300", "  ", [("a", "xii, 320 p.")]),
        ("650", " 0", [("a", "Cats"), ("x", "Food")]), ("852", "  ", [("a", "ORG"), ("j", "S-1")]), ("856", "40", [("u", "http://Host.example/Path/x"), ("q", "text/html")]), ("979", "  ", [("a", "dl")]),
    ],
)


def marcs(spark, *records):
    rows = [(k, r) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, f"pos long, marc {MARC_RECORD.simpleString()}")


def test_iso2709_round_trip(spark):
    long = record([("001", "ключ é")], [("245", "10", [("a", "Заглавие 日本"), ("b", "x" * 3000)]), ("500", "  ", [])])
    made = marcs(spark, BOOK, long).select("pos", "marc", marc_source.to_iso2709(F.col("marc")).alias("iso"))
    for r in made.select("marc", "iso", marc_source.parsed(F.col("iso")).alias("back")).collect():
        assert r.back.controlfield == r.marc.controlfield and r.back.datafield == r.marc.datafield
        assert int(r.iso[:5]) == len(r.iso.encode()) and r.iso.endswith("\x1e\x1d")
    assert one(spark, marc_source.parsed(F.col("v")), "short") is None


def test_marc_files(spark, tmp_path):
    iso = [r.iso for r in marcs(spark, BOOK, BOOK).select(marc_source.to_iso2709(F.col("marc")).alias("iso")).collect()]
    (tmp_path / "a.mrc").write_bytes("".join(iso).encode())
    got = marc_source.read_marc(spark, str(tmp_path / "a.mrc"))
    assert got.count() == 2 and got.first()["marc"].controlfield[0].value == "RU/42"
    assert registry.read_records(spark, str(tmp_path / "a.mrc"), registry.MARC, limit=1).count() == 1
    xml = marcs(spark, BOOK).select(marc_source.to_slim_xml(F.col("marc")).alias("x")).first()["x"]
    (tmp_path / "a.xml").write_text(f"<collection>{xml}{xml}</collection>")
    back = marc_source.read_marcxml(spark, str(tmp_path / "a.xml"))
    assert back.count() == 2 and back.first()["marc"].datafield[1].subfield[1].value == "sub & <title>"
    assert one(spark, registry.sniff(F.col("v")), iso[0]) == registry.MARC and one(spark, registry.sniff(F.col("v")), xml) == registry.MARCXML


def test_marc_accessors_and_dates(spark):
    m = F.col("marc")
    got = marcs(spark, BOOK).select(
        marc.schema(m).alias("schema"), marc.record_type(m).alias("type"), marc.kind(m).alias("kind"), marc.source(m).alias("source"), marc.key(m).alias("key"), marc.dates(m).alias("d"), marc.items(m).alias("items"),
    ).first()
    assert (got.schema, got.type, got.kind, got.source, got.key) == ("marc21", "bibliographic", "instance", "LIB", "RU/42")
    assert got.d.date_start == dt.datetime(1999, 1, 1) and got.d.record_updated == dt.datetime(2020, 1, 2, 3, 4, 5) and got.d.published == dt.datetime(1999, 12, 31)
    assert [tuple(i) for i in got["items"]] == [("ORG", "S-1")]


def test_marc_tuples(spark):
    rows = marcs(spark, BOOK, record([("001", "x")], leader=None)).withColumns({"record": F.lit("raw"), "media_type": F.lit(registry.MARC)})
    got = marc_source.tuples(rows, generate_collections=True).collect()
    nodes = {(r.kind, r.source, r.key) for r in got if r.kind}
    edges = {(r.kind_from, r.key_from, r.relation_kind, r.kind_to, r.key_to) for r in got if r.kind_from}
    assert nodes == {("instance", "lib", "ru/42"), ("item", "org", "s-1"), ("collection", "lib", "dl")}
    assert edges == {("instance", "ru/42", "item", "item", "s-1"), ("url", "/path/x", "relatedTo", "instance", "ru/42"), ("collection", "dl", "item", "instance", "ru/42")}


def test_marc_to_publication(spark):
    rows = marcs(spark, BOOK).select(marc_source.to_iso2709(F.col("marc")).alias("record"), F.lit(registry.MARC).alias("media_type"))
    body = json.loads(convert.converted(rows, registry.OPDS).first()["converted"])
    meta = body["metadata"]
    assert meta["title"] == "A title" and meta["type"] == "Book" and meta["numberOfPages"] == 320 and meta["publisher"] == "Pub" and meta["language"] == ["eng"]
    assert meta["author"][0] == {"name": "Doe, J.", "birthDate": "1950", "deathDate": "2010"} and meta["subject"]["topic"] == ["Cats -- Food"]
    assert body["links"][0]["rel"] == "http://opds-spec.org/acquisition"
    work = json.loads(convert.converted(rows, registry.LD_JSON).first()["converted"])
    assert work["hasInstance"]["extent"] == ["xii, 320 p."] and convert.converted(rows, "text/none").first()["converted"] == rows.first()["record"]
    assert registry.OPDS in convert.targets(registry.MARC)


def test_rusmarc_is_retagged(spark):
    rus = record([("001", "7"), ("005", "20200101000000.0")], [("100", "  ", [("a", "20180305d2017    |||y0rusy50      ca")]), ("200", "1 ", [("a", "Книга")]), ("700", " 1", [("a", "Иванов")]), ("801", " 0", [("b", "RuLib")]), ("710", "02", [("a", "Org")])])
    got = marcs(spark, rus).select(marc.schema(F.col("marc")).alias("s"), convert.either_marc(F.col("marc")).alias("m"), marc.dates(F.col("marc"))["date_start"].alias("d")).first()
    tags = {f.tag: f for f in got.m.datafield}
    assert got.s == "rusmarc" and tags["245"].subfield[0].value == "Книга" and tags["100"].subfield[0].value == "Иванов" and "110" in tags
    control = {f.tag: f.value for f in got.m.controlfield}
    assert control["003"] == "RuLib" and control["008"][:15] == "180305s2017    " and len(control["008"]) == 40 and got.d == dt.datetime(2017, 1, 1)


def test_tsv(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("kind\tsource\tkey\trecord.title\trecord.year\n item \ts\t1\tA \"q\"\t\nitem\ts\t2\n\n")
    (tmp_path / "e.tsv").write_text("kind_from\tsource_from\tkey_from\trelation_kind\tkind_to\tsource_to\tkey_to\r\na\ts\t1\tr\tb\ts\t2\r\n")
    rows = tsv.read_tsv(spark, str(tmp_path / "*.tsv"))
    got = {(r.kind, r.key, r.kind_from, r.key_to, r.record) for r in tsv.tuples(rows).collect()}
    head = "kind\tsource\tkey\trecord.title\trecord.year"
    assert got == {(" item ", "1", None, None, f'{head}\n item \ts\t1\tA "q"\t'), ("item", "2", None, None, f"{head}\nitem\ts\t2"), (None, None, "a", "2", None)}
    nested = [json.loads(r.j) for r in rows.where("array_contains(names, 'kind')").orderBy("pos").select(tsv.nested_json(F.col("names"), F.col("cells")).alias("j")).collect()]
    assert nested == [{"kind": " item ", "source": "s", "key": "1", "record": {"title": 'A "q"'}}, {"kind": "item", "source": "s", "key": "2"}]


def test_column_format_and_writer(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("value\tkind\tsource\tkey\tpath\nv1\tk\ts\t1\ta\nv2\tk\ts\t2\ta\nv3\tk\ts\t1\tb\n")
    got = {r.key: r.record for r in tsv.column_format_records(tsv.read_tsv(spark, str(tmp_path / "c.tsv"))).collect()}
    assert got["1"].split("\n") == ["value\tkind\tsource\tkey\tpath", "v1\tk\ts\t1\ta", "v3\tk\ts\t1\tb"] and len(got) == 2
    rows = spark.createDataFrame([("x", None, dt.datetime(2020, 1, 2))], "b string, a string, t timestamp").coalesce(1)
    tsv.write_tsv(rows, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv")) == "a\tb\tt\n\tx\t2020-01-02T00:00:00.000Z\n"


def test_quads(spark):
    lines = ['<http://u.example/1> <http://w#prefLabel> "Ein \\"Wort\\""@de .', "<http://u.example/1> <http://w#broader> <http://u.example/0> <http://g> .", "_:b <http://w#note> \"x\"^^<http://t> .", "# none", "bad"]
    frame = spark.createDataFrame([(x,) for x in lines], "record string")
    got = {r.subject: r.statements for r in quads.subjects(frame).collect()}
    assert set(got) == {"http://u.example/1", "_:b"} and got["http://u.example/1"][0].graph == "http://g"
    assert (got["http://u.example/1"][1].object, got["http://u.example/1"][1].language) == ('Ein "Wort"', "de")
    assert {(r.kind, r.source, r.key) for r in quads.tuples(frame).collect()} == {("concept", "u.example", "1"), ("concept", "_", "b")}
    body = json.loads(quads.tuples(frame).where("key = '1'").select(convert.quads_to_opds(F.col("record")).alias("j")).first()["j"])
    assert body["metadata"]["title"][0]["language"] == "de"


def test_feeds(spark, tmp_path):
    pub = json.dumps({"metadata": {"identifier": "host/a/1", "@type": "http://schema.org/ScholarlyArticle", "issn": "1234-5678", "modified": "2020-01-01T00:00:00Z"}})
    got = feeds.opds_tuples(spark.createDataFrame([(pub,)], "record string")).collect()
    assert {(r.kind, r.source, r.key) for r in got if r.kind} == {("scholarly_article", "host", "a/1")} and {r.key_from for r in got if r.kind_from} == {"1234-5678"}
    (tmp_path / "f.xml").write_text('<feed><entry><id>http://h.example/e/1</id><title>T</title><updated>2020-01-01T00:00:00Z</updated></entry></feed>')
    assert feeds.atom_tuples(feeds.read_atom(spark, str(tmp_path / "f.xml"))).first()["source"] == "h.example"
    (tmp_path / "b.xml").write_text('<r><updated-book id="1" external_id="ab" updated="2020-01-01 00:00:00" allow_sell="1" type="4" chars="200"><title-info><book-title>B</book-title><author><first-name>A</first-name><last-name>C</last-name></author></title-info></updated-book></r>')
    books = feeds.read_books(spark, str(tmp_path / "b.xml"))
    p = books.select(feeds.book_publication(F.struct("*")).alias("p")).first()["p"]
    assert feeds.book_tuples(books).first()["key"] == "ab" and (p.numberOfPages, p.duration, p.author) == (200, None, ["A C"])
    journals = spark.createDataFrame([("1", "J", [("i1", 86400, [("p1", "T")])])], "issn string, title string, issues array<struct<product_id: string, date_public: long, articles: array<struct<external_pid: string, title: string>>>>")
    assert feeds.journal_tuples(journals).count() == 5
    cards = feeds.card_rows(spark.createDataFrame([(1, "<table><tr><th>a<b>b</b></th><td>c</td></tr><tr><td>d</td></tr></table>")], "page_id int, html string"))
    assert [r.cells for r in cards.collect()] == [["a b", "c"], ["d"]]


@pytest.mark.parametrize(("given", "want"), [
    ("", None), ("<feed xmlns='x'><entry/></feed>", registry.ATOM), ("<ONIXMessage>", registry.ONIX), ("<html>", registry.HTML), ('{"metadata": {}}', registry.OPDS), ('{"a": 1}', registry.JSON),
    ('{"@context": "x"}', registry.LD_JSON), ('<a> <b> "c" .', registry.QUADS), ("a\tb\n1\t2", registry.TSV), ("<rdf:RDF>", registry.RDF), ("hello", "text/plain"), ("<?xml version='1.0'?><x/>", registry.XML),
])
def test_sniff(spark, given, want):
    assert one(spark, registry.sniff(F.col("v")), given) == want
