"""The catalogue's queries over formats: records built from the tables, read, written and converted.

Readers and writers work on files, so these queries write what they read into a folder of their own
below ``spark.checkpoint.dir`` (on this machine alone, a temporary one).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, text
from .functions import marc as M
from .model import MARC_RECORD
from .operators import stats, vocabulary
from .operators import store as S
from .plans import convert, feed
from .queries import query
from .sources import feeds, registry, tsv
from .sources import marc as marc_source
from .sources.tables import graph, spread, table


def _scratch(spark: SparkSession, name: str) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="folioweave-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, lines: DataFrame, name: str, separator: str = "\n", **options: str) -> str:
    """The folder of text files that hold the lines."""
    path = _scratch(spark, name)
    lines.write.options(lineSep=separator, **options).text(path)
    return path


def _xml(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """The folder of XML files that hold the elements, some thousand each.

    A file has one root, and what follows that isn't read, so a task that has several documents writes a file for each.
    """
    part = F.shiftright(F.monotonically_increasing_id(), 12)
    whole = F.concat(F.lit("<all>"), F.array_join(F.collect_list("value"), "\n"), F.lit("</all>")).alias("value")
    documents = lines.select(part.alias("part"), "value").groupBy("part").agg(whole).select("value")
    return _written(spark, documents, name, maxRecordsPerFile="1")


def _marc(leader: str | Column, control: dict[str, Column], data: list[tuple[str, str, str, dict[str, Column]]]) -> Column:
    """A MARC record of columns."""
    lead = F.lit(leader) if isinstance(leader, str) else leader
    fields = [F.struct(F.lit(t).alias("tag"), F.lit(a).alias("ind1"), F.lit(b).alias("ind2"), F.array(*[F.struct(F.lit(c).alias("code"), v.alias("value")) for c, v in subs.items()]).alias("subfield")) for t, a, b, subs in data]
    return F.struct(lead.alias("leader"), F.array(*[F.struct(F.lit(t).alias("tag"), v.alias("value")) for t, v in control.items()]).alias("controlfield"), F.array(*fields).alias("datafield")).cast(MARC_RECORD.simpleString())


LEADER = "00000nam a2200000 i 4500"


def _key(c: str) -> Column:
    return F.col(c).cast("string")


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Parts as MARC 21 records of books."""
    year = (F.lit(1900) + F.col("p_size")).cast("string")
    f008 = F.concat(F.lit("200315s"), year, F.lit("    ru "), F.lit(" " * 17), F.lit("rus d"))
    rec = _marc(
        LEADER, {"001": F.concat(F.lit("b/"), _key("p_partkey")), "003": F.lit("LibA"), "005": F.lit("20200102030405.0"), "008": f008},
        [
            ("020", " ", " ", {"a": F.lit("978-5-00000-000-1")}), ("040", " ", " ", {"a": F.lit("LibA")}), ("100", "1", " ", {"a": F.col("p_brand"), "d": F.lit("1900-1970"), "4": F.lit("aut")}),
            ("245", "0", "0", {"a": F.concat("p_name", F.lit(" é : ")), "b": F.col("p_type")}), ("260", " ", " ", {"a": F.lit("Moscow"), "b": F.col("p_brand"), "c": year}),
            ("300", " ", " ", {"a": F.concat(_key("p_size"), F.lit(" p."))}), ("650", " ", "0", {"a": F.col("p_type"), "x": F.lit("History")}),
            ("852", " ", " ", {"a": F.lit("LibB"), "j": F.concat(F.lit("S"), _key("p_partkey"))}), ("856", "4", "0", {"u": F.concat(F.lit("https://x.example/"), _key("p_partkey")), "q": F.lit("text/html")}),
        ],
    )
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", "p_name", rec.alias("marc"))


# Readers and writers


@query("SELECT 'customer' AS kind, lower(c_mktsegment) AS source, CAST(c_custkey AS VARCHAR) AS key, c_name AS title FROM customer")
def tsv_round_trip(spark, d):
    path = _scratch(spark, "tsv")
    own = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.lower("c_mktsegment").alias("source"), _key("c_custkey").alias("key"), F.col("c_name").alias("title"))
    tsv.write_tsv(own, path)
    rows = tsv.read_tsv(spark, path)
    return rows.select(*[tsv.cell(c).alias(c) for c in ("kind", "source", "key", "title")])


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, count(*) AS n_lines, min(n_name) AS least FROM nation GROUP BY 1")
def tsv_column_format(spark, d):
    line = F.concat_ws("\t", "n_name", F.lit("region"), F.lit("s"), _key("n_regionkey"), F.lit("record.name"))
    head = spark.createDataFrame([("value\tkind\tsource\tkey\tpath",)], "value string")
    path = _written(spark, head.unionByName(table(spark, d, "nation").select(line.alias("value"))).coalesce(1), "columns")
    found = tsv.column_format_records(tsv.read_tsv(spark, path))
    values = F.transform(F.slice(F.split("record", "\n"), 2, 1000), lambda x: F.get(F.split(x, "\t"), F.lit(0)))
    return found.select("key", F.size(values).cast("long").alias("n_lines"), F.array_min(values).alias("least"))


@query("SELECT p_partkey, 'b/' || CAST(p_partkey AS VARCHAR) AS id, p_name || ' é : ' AS title, p_type AS rest, 8 + 1 AS n_fields FROM part")
def iso2709_round_trip(spark, d):
    """Written, split at record marks, and read again."""
    lines = _books(spark, d).select(F.rtrim(marc_source.to_iso2709(F.col("marc")), F.lit("\x1d")).alias("value"))
    m, key = F.col("marc"), M.control(F.col("marc"), "001")
    found = marc_source.read_marc(spark, _written(spark, lines, "marc", "\x1d"))
    return found.select(F.get(F.split(key, "/"), F.lit(1)).cast("long").alias("p_partkey"), key.alias("id"), M.first(m, "245", "a").alias("title"), M.first(m, "245", "b").alias("rest"), F.size(m["datafield"]).alias("n_fields"))


@query("SELECT p_partkey, p_name || ' é : ' AS title, p_brand || '|Moscow' AS publisher FROM part")
def marcxml_round_trip(spark, d):
    lines = _books(spark, d).select(marc_source.to_slim_xml(F.col("marc")).alias("value"))
    m = F.col("marc")
    found = marc_source.read_marcxml(spark, _xml(spark, lines, "marcxml"))
    return found.select(F.get(F.split(M.control(m, "001"), "/"), F.lit(1)).cast("long").alias("p_partkey"), F.concat(F.rtrim(M.first(m, "245", "a")), F.lit(" ")).alias("title"), F.concat_ws("|", M.first(m, "260", "b"), M.first(m, "260", "a")).alias("publisher"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    c = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    entry = F.concat(
        F.lit("<entry>"), c("id", F.concat(F.lit("https://atom.example/c/"), _key("c_custkey"))), c("title", F.col("c_name")), c("updated", F.lit("2021-02-03T04:05:06")), c("author", c("name", F.col("c_mktsegment"))),
        F.lit('<link href="https://l.example/" rel="alternate"/><category term="t" label="'), F.col("c_mktsegment"), F.lit('"/></entry>'),
    )
    return table(spark, d, "customer").select(entry.alias("value"))


@query("SELECT 'publication' AS kind, 'atom.example' AS source, '/c/' || CAST(c_custkey AS VARCHAR) AS key, TIMESTAMP '2021-02-03 04:05:06' AS time_source FROM customer")
def atom_entries(spark, d):
    return feeds.atom_tuples(feeds.read_atom(spark, _xml(spark, _entries(spark, d), "atom"))).select("kind", "source", "key", "time_source")


@query("SELECT 'book' AS kind, 'src' AS source, CAST(c_custkey AS VARCHAR) AS key, NULL AS key_from, NULL AS key_to FROM customer UNION ALL SELECT NULL, NULL, NULL, '1234-' || CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey > 3")
def opds_publications(spark, d):
    issn = F.when(F.col("c_nationkey") > 3, F.concat(F.lit("1234-"), _key("c_nationkey")))
    meta = F.struct(F.concat(F.lit("urn:(src)"), _key("c_custkey")).alias("identifier"), F.lit("http://schema.org/Book").alias("@type"), F.lit("2020-01-01").alias("modified"), issn.alias("issn"))
    records = table(spark, d, "customer").select(F.to_json(F.struct(meta.alias("metadata"))).alias("record"))
    return feeds.opds_tuples(records).select("kind", "source", "key", "key_from", "key_to")


@query("SELECT 'u' || CAST(c_custkey AS VARCHAR) AS key, TIMESTAMP '2020-05-06 07:08:09' AS at, 'updated' AS what FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'r' || CAST(c_custkey AS VARCHAR), TIMESTAMP '2021-05-06 00:00:00', 'removed' FROM customer WHERE c_custkey % 2 = 1")
def publishers_books(spark, d):
    """Updated and removed books of one feed."""
    even = F.col("c_custkey") % 2 == 0
    up = F.concat(F.lit('<updated-book id="x" external_id="u'), _key("c_custkey"), F.lit('" updated="2020-05-06 07:08:09" type="0" chars="9"><title-info><book-title>T</book-title></title-info></updated-book>'))
    gone = F.concat(F.lit('<removed-book id="r'), _key("c_custkey"), F.lit('" removed="2021-05-06"/>'))
    path = _xml(spark, table(spark, d, "customer").select(F.when(even, up).otherwise(gone).alias("value")), "books")
    books = feeds.book_tuples(feeds.read_books(spark, path)).select("key", F.col("time_source").alias("at"), F.lit("updated").alias("what"))
    return books.unionByName(feeds.read_removed_books(spark, path).select("key", F.col("removed").alias("at"), F.lit("removed").alias("what")))


@query("WITH n AS (SELECT n_nationkey, n_regionkey FROM nation) SELECT 'periodical' AS kind, 'i' || CAST(r_regionkey AS VARCHAR) AS key, NULL AS key_from, NULL AS key_to FROM region UNION ALL SELECT 'publication_issue', 'p' || CAST(r_regionkey AS VARCHAR), NULL, NULL FROM region UNION ALL SELECT NULL, NULL, 'i' || CAST(r_regionkey AS VARCHAR), 'p' || CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 'scholarly_article', 'a' || CAST(n_nationkey AS VARCHAR), NULL, NULL FROM n UNION ALL SELECT NULL, NULL, 'p' || CAST(n_regionkey AS VARCHAR), 'a' || CAST(n_nationkey AS VARCHAR) FROM n")
def journal_issues(spark, d):
    article = F.concat(F.lit("<article><external_pid>a"), _key("n_nationkey"), F.lit("</external_pid><title>A%20title</title></article>"))
    articles = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(article)), "").alias("a"))
    line = F.concat(F.lit("<journal><issn>i"), _key("n_regionkey"), F.lit("</issn><title>The%20one</title><issues><issue><product_id>p"), _key("n_regionkey"), F.lit("</product_id><date_public>1600000000</date_public><articles>"), "a", F.lit("</articles></issue></issues></journal>"))
    found = feeds.journal_tuples(feeds.read_journals(spark, _xml(spark, articles.select(line.alias("value")), "journals")))
    return found.select("kind", "key", "key_from", "key_to")


def _dump(spark: SparkSession, d: str) -> DataFrame:
    """Nations as copies, regions as items of a registry dump, joined again."""
    listed = lambda df, *cols: df.select(F.collect_list(F.struct(*cols)).alias("x"))
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    copies = listed(nation, _key("n_nationkey").alias("id"), _key("n_regionkey").alias("part_id"), F.lit("u").alias("user_id"), _key("n_nationkey").alias("num"), (F.col("n_nationkey") == 3).alias("deleted"))
    parts = listed(region, _key("r_regionkey").alias("id"), _key("r_regionkey").alias("item_id"), F.concat(F.lit("part "), "r_name").alias("name"))
    items = listed(region, _key("r_regionkey").alias("id"), F.col("r_name").alias("title"), F.lit("Ann").alias("author"), F.lit("1950").alias("year"), F.lit("g").alias("doc_type"), F.lit(False).alias("deleted"))
    one = spark.range(1).select(F.array(F.struct(F.lit("u").alias("id"), F.lit("Lib").alias("name"))).alias("users"), F.array(F.struct(F.lit("g").alias("id"), F.lit("Group").alias("name"))).alias("directories"))
    whole = one.join(F.broadcast(copies.withColumnRenamed("x", "copies"))).join(F.broadcast(parts.withColumnRenamed("x", "parts"))).join(F.broadcast(items.withColumnRenamed("x", "items")))
    t = feeds.read_registry(spark, _written(spark, whole.select(F.to_json(F.struct("*")).alias("value")), "dump"))
    return vocabulary.registry_items(t["copies"], t["parts"], t["items"], t["users"], t["directories"])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, r_name || '. part ' || r_name AS title, 'Ann' AS author, 'Group' AS series, 'Lib' AS collection FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey <> 3")
def registry_publications(spark, d):
    records = _dump(spark, d).select(F.to_json(F.struct("item", "part", "instance", "organization", "group")).alias("record"), F.lit(registry.REGISTRY).alias("media_type"))
    return convert.converted(records, registry.OPDS, sources=(registry.REGISTRY,)).select(*[F.get_json_object("converted", f"$.metadata.{p}").alias(n) for n, p in (("id", "identifier"), ("title", "title"), ("author", "author[0].name"), ("series", "belongsTo.series[0]"), ("collection", "belongsTo.collection[0]"))])


@query("SELECT 'isbn:' || CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS author, p_type AS publisher, CAST(p_size AS INT) AS pages FROM part")
def onix_publications(spark, d):
    el = lambda name, *v: F.concat(F.lit(f"<{name}>"), *v, F.lit(f"</{name}>"))
    product = el(
        "Product", el("RecordReference", F.lit("r")), el("ProductIdentifier", el("ProductIDType", F.lit("15")), el("IDValue", _key("p_partkey"))),
        el("DescriptiveDetail", el("TitleDetail", el("TitleElement", el("TitleText", F.col("p_name")))), el("Contributor", el("PersonName", F.col("p_brand")), el("ContributorRole", F.lit("A01"))), el("Extent", el("ExtentType", F.lit("00")), el("ExtentValue", _key("p_size")))),
        el("PublishingDetail", el("Publisher", el("PublisherName", F.col("p_type")))),
    )
    path = _xml(spark, table(spark, d, "part").select(product.alias("value")), "onix")
    records = registry.read_xml_records(spark, path, registry.ONIX, convert.ONIX_SCHEMA).select(F.to_json(F.struct("*")).alias("record"), F.lit(registry.ONIX).alias("media_type"))
    got = lambda p: F.get_json_object("converted", f"$.metadata.{p}")
    return convert.converted(records, registry.OPDS, sources=(registry.ONIX,)).select(got("identifier").alias("id"), got("title").alias("title"), got("author[0].name").alias("author"), got("publisher").alias("publisher"), got("numberOfPages").cast("int").alias("pages"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS value FROM customer")
def gzip_records(spark, d):
    path = _written(spark, table(spark, d, "customer").select(_key("c_custkey").alias("value")), "gzip", compression="gzip")
    return registry.read_records(spark, path, registry.TSV).select(F.col("record").alias("value"))


@query("SELECT CAST(7 AS BIGINT) AS n")
def import_limit(spark, d):
    path = _written(spark, table(spark, d, "nation").select("n_name"), "limit")
    return registry.read_records(spark, path, registry.TSV, 7).agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, n_name AS first, CAST(n_nationkey AS VARCHAR) AS second FROM nation")
def card_tables(spark, d):
    row = F.concat(F.lit("<tr><td> <b>"), "n_name", F.lit("</b></td><TD class=x>"), _key("n_nationkey"), F.lit("</td></tr>"))
    pages = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    return feeds.card_rows(pages).select("n_regionkey", F.get("cells", F.lit(0)).alias("first"), F.get("cells", F.lit(1)).alias("second"))


#: What comes before and after a customer's name in a record, and the record's media type.
_SHAPES = (
    ("00026nam a2200025 i 4500", "", registry.MARC), ("<?xml version=\"1.0\"?><collection><record><leader>", "</leader></record></collection>", registry.MARCXML), ("<ONIXMessage><Product>", "</Product></ONIXMessage>", registry.ONIX),
    (" <feed><entry>", "</entry></feed>", registry.ATOM), ("<updated-book>", "</updated-book>", registry.LITRES), ("<journals><title>", "</title></journals>", registry.JES), ("<rdf:RDF>", "</rdf:RDF>", registry.RDF),
    ("<!DOCTYPE html><p>", "", registry.HTML), ('<?xml version="1.0"?><other>', "</other>", registry.XML), ('{"@context": "', '"}', registry.LD_JSON), ('{"metadata": {"title": "', '"}}', registry.OPDS),
    ('{"copies": ["', '"], "parts": []}', registry.REGISTRY), ('[1, "', '"]', registry.JSON), ('<http://a> <http://b> "', '" .', registry.QUADS), ("a\t", "\tb", registry.TSV), ("--- \nname: ", "", registry.YAML), ("plain ", " words", "text/plain"),
)


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 20 >= {len(_SHAPES)} THEN NULL ELSE [" + ", ".join(f"'{t}'" for _, _, t in _SHAPES) + "][1 + c_custkey % 20] END AS media_type FROM customer")
def sniffed_media_types(spark, d):
    """Records of all media types around customers' names, and empty ones."""
    shapes = F.array(*[F.struct(F.lit(x).alias("before"), F.lit(y).alias("after")) for x, y, _ in _SHAPES])
    own = table(spark, d, "customer").select("c_custkey", "c_name", F.get(shapes, (F.col("c_custkey") % 20).cast("int")).alias("s"))
    record = F.when(F.col("s").isNotNull(), F.concat("s.before", "c_name", "s.after")).otherwise(F.lit("  "))
    return own.select("c_custkey", registry.sniff(record).alias("media_type"))


# Feeds and exports


@query("SELECT 'https://c.example/resources/nation/store/' || CAST(n_nationkey AS VARCHAR) AS identifier, CAST(x.n AS BIGINT) AS items, CAST(least(x.n, 10) AS BIGINT) AS listed FROM nation LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1) x ON x.k = n_nationkey ORDER BY n_nationkey DESC LIMIT 10")
def feed_publications(spark, d):
    """A page of nations as publications, each with its own newest ten edges."""
    g = graph(spark, d)
    found = feed.publications(g, S.list_kind(g, "nation", limit=10), "https://c.example", 10)
    return found.select(F.col("metadata.identifier").alias("identifier"), F.col("metadata.numberOfItems").alias("items"), F.size("items").cast("long").alias("listed"))


@query("SELECT 'nation' AS title, CAST(10 AS BIGINT) AS n, 'nation-' || CAST(max(n_nationkey) - 9 AS VARCHAR) AS after, 'https://c.example/resources/nation/store/' || CAST(max(n_nationkey) AS VARCHAR) AS first FROM nation")
def kind_feed(spark, d):
    body = feed.kind_feed(graph(spark, d), "nation", "https://c.example", limit=10)
    got = lambda p: F.get_json_object("feed", p)
    return body.select(got("$.metadata.title").alias("title"), got("$.metadata.numberOfItems").cast("long").alias("n"), got("$.metadata.after").alias("after"), got("$.publications[0].metadata.identifier").alias("first"))


@query("SELECT 'seed__event__click__' || CAST(user_id AS VARCHAR) || '__p' || CAST(user_id % 3 AS VARCHAR) || '__' || CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS file, props AS record FROM events WHERE event_type = 'click' AND user_id = 1 ORDER BY event_id DESC LIMIT 1")
def raw_export(spark, d):
    g = graph(spark, d)
    return S.raw_export(g, "event", "click", "1").select("file", "record")


@query("SELECT DISTINCT 'p' || CAST(user_id % 3 AS VARCHAR) AS code FROM events")
def providers_listed(spark, d):
    return S.codes(graph(spark, d).details.select(F.col("provider").alias("code")))


# Conversions


_PUBLICATION = (
    "metadata struct<title: string, subtitle: string, type: string, publisher: string, language: array<string>, author: array<struct<name: string, birthDate: string>>, numberOfPages: int, subject: struct<topic: array<string>>, published: string>, "
    "links array<struct<href: string>>"
)


def _as_opds(records: DataFrame, source: str) -> DataFrame:
    """Publications, the JSON of each read once."""
    found = convert.converted(records, registry.OPDS, sources=(source,)).select(F.from_json("converted", _PUBLICATION).alias("p")).select("p.metadata", "p.links")
    m, author = F.col("metadata"), F.get("metadata.author", F.lit(0))
    return found.select(
        m["title"].alias("title"), m["subtitle"].alias("subtitle"), m["type"].alias("type"), m["publisher"].alias("publisher"), F.get("metadata.language", F.lit(0)).alias("language"), author["name"].alias("author"),
        author["birthDate"].alias("born"), m["numberOfPages"].alias("pages"), F.get("metadata.subject.topic", F.lit(0)).alias("topic"), F.substring(m["published"], 1, 4).alias("year"), F.get("links", F.lit(0))["href"].alias("href"),
    )


_OPDS_OF_PARTS = "SELECT p_name || ' é' AS title, p_type AS subtitle, 'Book' AS type, p_brand AS publisher, 'rus' AS language, p_brand AS author, '1900' AS born, CAST(p_size AS INT) AS pages, p_type || ' -- History' AS topic, CAST(1900 + p_size AS VARCHAR) AS year, 'https://x.example/' || CAST(p_partkey AS VARCHAR) AS href FROM part"


@query(_OPDS_OF_PARTS)
def marc21_publications(spark, d):
    return _as_opds(_books(spark, d).select(marc_source.to_iso2709(F.col("marc")).alias("record"), F.lit(registry.MARC).alias("media_type")), registry.MARC)


@query(_OPDS_OF_PARTS)
def marcxml_publications(spark, d):
    return _as_opds(_books(spark, d).select(marc_source.to_slim_xml(F.col("marc")).alias("record"), F.lit(registry.MARCXML).alias("media_type")), registry.MARCXML)


@query("SELECT 'b/' || CAST(p_partkey AS VARCHAR) AS id, p_name || ' é : ' AS title FROM part")
def marcxml_as_marc(spark, d):
    own = _books(spark, d).select(F.to_json("marc").alias("record"), F.lit(registry.MARCXML).alias("media_type"))
    again = convert.converted(own, registry.MARC, sources=(registry.MARCXML,)).select(marc_source.parsed(F.col("converted")).alias("m"))
    return again.select(M.control(F.col("m"), "001").alias("id"), M.first(F.col("m"), "245", "a").alias("title"))


@query("SELECT p_name || ' é : ' AS title, p_brand AS agent, 'rus' AS language, 'Moscow' AS place, CAST(p_size AS VARCHAR) || ' p.' AS extent FROM part")
def marcxml_as_bibframe(spark, d):
    own = _books(spark, d).select(marc_source.to_slim_xml(F.col("marc")).alias("record"), F.lit(registry.MARCXML).alias("media_type"))
    got = lambda p: F.get_json_object("converted", f"$.{p}")
    return convert.converted(own, registry.LD_JSON, sources=(registry.MARCXML,)).select(got("title[0]").alias("title"), got("contribution[0].agent").alias("agent"), got("language[0]").alias("language"), got("hasInstance.provisionActivity.place[0]").alias("place"), got("hasInstance.extent[0]").alias("extent"))


def _rusmarc(spark: SparkSession, d: str) -> DataFrame:
    year = (F.lit(1900) + F.col("p_size")).cast("string")
    coded = F.rpad(F.concat(F.lit("20200315d"), year, F.lit("    ")), 36, "y")
    rec = _marc(
        LEADER, {"001": _key("p_partkey"), "005": F.lit("20200102030405.0")},
        [
            ("100", " ", " ", {"a": coded}), ("101", "0", " ", {"a": F.lit("rus"), "c": F.lit("eng")}), ("200", "1", " ", {"a": F.col("p_name"), "e": F.col("p_type"), "f": F.col("p_brand")}),
            ("210", " ", " ", {"a": F.lit("Moscow"), "c": F.col("p_brand"), "d": year}), ("215", " ", " ", {"a": F.lit("9 p."), "c": F.lit("ill."), "d": F.lit("20 cm")}), ("606", " ", " ", {"a": F.col("p_type"), "y": F.lit("Volga"), "z": F.lit("19th")}),
            ("700", " ", "1", {"a": F.lit("Ivanov"), "b": F.lit("I."), "f": F.lit("1900-"), "4": F.lit("070")}), ("801", " ", "0", {"a": F.lit("RU"), "b": F.lit("LibR"), "c": F.lit("20200315")}),
        ],
    )
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", rec.alias("marc"))


@query("SELECT p_partkey, p_name AS title, p_type AS rest, p_brand AS statement, 'Moscow' AS place, p_brand AS publisher, CAST(1900 + p_size AS VARCHAR) AS date, '9 p.|ill.|20 cm' AS physical, p_type || '|19th|Volga' AS topic, 'Ivanov, I.' AS name, '1900-' AS life, 'rus|eng' AS language, 'LibR' AS agency, 's' || CAST(1900 + p_size AS VARCHAR) AS coded FROM part")
def rusmarc_as_marc21(spark, d):
    m = convert.either_marc(F.col("marc"))
    own = _rusmarc(spark, d).select("p_partkey", m.alias("m"))
    first = lambda t, c: M.first(F.col("m"), t, c)
    joined = lambda t, *cs: F.concat_ws("|", *[first(t, c) for c in cs])
    return own.select(
        "p_partkey", first("245", "a").alias("title"), first("245", "b").alias("rest"), first("245", "c").alias("statement"), first("260", "a").alias("place"), first("260", "b").alias("publisher"), first("260", "c").alias("date"),
        joined("300", "a", "b", "c").alias("physical"), joined("650", "a", "y", "z").alias("topic"), first("100", "a").alias("name"), first("100", "d").alias("life"), joined("041", "a", "h").alias("language"), first("040", "a").alias("agency"),
        F.substring(M.control(F.col("m"), "008"), 7, 5).alias("coded"),
    )


@query("SELECT c_name AS title, 'customer/store/' || CAST(c_custkey AS VARCHAR) AS identifier, c_mktsegment AS segment FROM customer")
def tsv_publications(spark, d):
    record = F.concat(F.lit("kind\tsource\tkey\trecord.title\trecord.segment\n"), F.concat_ws("\t", F.lit("customer"), F.lit("store"), _key("c_custkey"), "c_name", "c_mktsegment"))
    own = table(spark, d, "customer").select(record.alias("record"), F.lit(registry.TSV).alias("media_type"))
    got = lambda p: F.get_json_object("converted", f"$.metadata.{p}")
    return convert.converted(own, registry.OPDS, sources=(registry.TSV,)).select(got("title").alias("title"), got("identifier").alias("identifier"), got("about.segment").alias("segment"))


@query("SELECT c_name AS title, 'https://atom.example/c/' || CAST(c_custkey AS VARCHAR) AS identifier, c_mktsegment AS author, c_mktsegment AS subject FROM customer")
def atom_publications(spark, d):
    entries = feeds.read_atom(spark, _xml(spark, _entries(spark, d), "atom"))
    own = entries.select(F.to_json(F.struct("*")).alias("record"), F.lit(registry.ATOM).alias("media_type"))
    got = lambda p: F.get_json_object("converted", f"$.metadata.{p}")
    return convert.converted(own, registry.OPDS, sources=(registry.ATOM,)).select(got("title").alias("title"), got("identifier").alias("identifier"), got("author[0].name").alias("author"), got("subject[0]").alias("subject"))


@query("SELECT p_name AS title, p_brand AS author, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE -1 END AS BIGINT) AS pages, CAST(CASE WHEN p_size % 2 = 1 THEN p_size ELSE -1 END AS BIGINT) AS extent FROM part")
def book_publications(spark, d):
    info = F.struct(F.col("p_name").alias("book-title"), F.array(F.struct(F.col("p_brand").alias("last-name"))).alias("author"))
    book = F.struct(_key("p_partkey").alias("_id"), F.when(F.col("p_size") % 2 == 0, 4).otherwise(0).alias("_type"), F.col("p_size").cast("long").alias("_chars"), info.alias("title-info"))
    own = table(spark, d, "part").select(F.to_json(book).alias("record"), F.lit(registry.LITRES).alias("media_type"))
    got = lambda p: F.get_json_object("converted", f"$.metadata.{p}")
    return convert.converted(own, registry.OPDS, sources=(registry.LITRES,)).select(got("title").alias("title"), got("author[0]").alias("author"), F.coalesce(got("numberOfPages").cast("long"), F.lit(-1)).alias("pages"), F.coalesce(got("extent").cast("long"), F.lit(-1)).alias("extent"))


@query("SELECT 'http://q.example/' || CAST(n_nationkey AS VARCHAR) AS identifier FROM nation")
def quads_publications(spark, d):
    record = F.concat(F.lit("<http://q.example/"), _key("n_nationkey"), F.lit('> <http://www.w3.org/2004/02/skos/core#prefLabel> "'), "n_name", F.lit('"@en .'))
    own = table(spark, d, "nation").select(record.alias("record"), F.lit(registry.QUADS).alias("media_type"))
    return convert.converted(own, registry.OPDS, sources=(registry.QUADS,)).select(F.get_json_object("converted", "$.metadata.identifier").alias("identifier"))


# MARC accessors, statistics and dates


@query("SELECT p_partkey, 'marc21' AS schema, 'instance' AS kind, 'LibA' AS source, 'bibliographic' AS type, 'https://x.example/' || CAST(p_partkey AS VARCHAR) AS href, 'S' || CAST(p_partkey AS VARCHAR) AS copy, make_timestamp(1900 + p_size, 1, 1, 0, 0, 0) AS began, TIMESTAMP '2020-01-02 03:04:05' AS updated, TIMESTAMP '2020-03-15 00:00:00' AS entered FROM part")
def marc_accessors(spark, d):
    m, when = F.col("marc"), M.dates(F.col("marc"))
    return _books(spark, d).select(
        "p_partkey", M.schema(m).alias("schema"), M.kind(m).alias("kind"), M.source(m).alias("source"), M.record_type(m).alias("type"), F.get(M.links(m), F.lit(0))["href"].alias("href"), F.get(M.items(m), F.lit(0))["key"].alias("copy"),
        when["date_start"].alias("began"), when["record_updated"].alias("updated"), when["record_start"].alias("entered"),
    )


@query("SELECT 'instance' AS kind, 'b/' || CAST(p_partkey AS VARCHAR) AS key, NULL AS key_from, NULL AS key_to FROM part UNION ALL SELECT 'item', 's' || CAST(p_partkey AS VARCHAR), NULL, NULL FROM part UNION ALL SELECT NULL, NULL, 'b/' || CAST(p_partkey AS VARCHAR), 's' || CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT NULL, NULL, '/' || CAST(p_partkey AS VARCHAR), 'b/' || CAST(p_partkey AS VARCHAR) FROM part")
def marc_tuples(spark, d):
    own = _books(spark, d).select(F.to_json("marc").alias("record"), F.lit(registry.MARCXML).alias("media_type"), "marc", F.col("p_partkey").alias("pos"))
    return marc_source.tuples(own).select("kind", "key", "key_from", "key_to")


@query("SELECT 'a' AS record_type, '245$b' AS field, count(*) AS occurrences, arg_min(p_type, p_partkey) AS first_value, arg_max(p_type, p_partkey) AS last_value, CAST(sum(length(p_type)) AS BIGINT) AS symbols FROM part UNION ALL SELECT 'a', '260$b', count(*), arg_min(p_brand, p_partkey), arg_max(p_brand, p_partkey), CAST(sum(length(p_brand)) AS BIGINT) FROM part")
def marc_field_statistics(spark, d):
    own = _books(spark, d).select("marc", F.col("p_partkey").alias("pos"))
    return stats.marc_field_statistics(own).where(F.col("field").isin("245$b", "260$b"))


@query("SELECT c_custkey, make_timestamp(1900 + c_custkey % 90, 1, 1, 0, 0, 0) AS lo, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN make_timestamp(1990, 12, 31, 0, 0, 0) ELSE make_timestamp(1900 + c_custkey % 90, 12, 31, 0, 0, 0) END AS hi, CASE WHEN c_custkey % 3 = 2 THEN make_timestamp(1990, 1, 1, 0, 0, 0) END AS reissued FROM customer")
def coded_dates(spark, d):
    """Single dates, closed ranges and reissues."""
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, "s").when(k % 3 == 1, "i").otherwise("r")
    got = dates.coded_dates(code, F.concat((F.lit(1900) + k % 90).cast("string"), F.lit("1990")))
    return table(spark, d, "customer").select("c_custkey", got.alias("g")).select("c_custkey", F.col("g.date_start").alias("lo"), F.col("g.date_end").alias("hi"), F.col("g.reissue_start").alias("reissued"))


@query("SELECT p_partkey, make_timestamp(1900 + p_size, 1, 1, 0, 0, 0) AS began, TIMESTAMP '2020-03-15 00:00:00' AS entered FROM part")
def rusmarc_dates(spark, d):
    when = M.dates(F.col("marc"))
    return _rusmarc(spark, d).select("p_partkey", when["date_start"].alias("began"), when["record_start"].alias("entered"))


@query("SELECT c_custkey, make_timestamp(1950 + c_custkey % 50, CASE c_custkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 11 ELSE 1 END, CASE c_custkey % 3 WHEN 0 THEN 9 ELSE 1 END, 0, 0, 0) AS issued FROM customer")
def issued_dates(spark, d):
    k = F.col("c_custkey")
    year = (F.lit(1950) + k % 50).cast("string")
    written = F.when(k % 3 == 0, F.concat(F.lit("9 мая "), year, F.lit(" г."))).when(k % 3 == 1, F.concat(F.lit("11."), year)).otherwise(F.concat(F.lit("[Москва], "), year))
    return table(spark, d, "customer").select("c_custkey", dates.issued_date(written).alias("issued"))


@query("SELECT c_custkey, CAST(c_custkey // 60 AS VARCHAR) || ':' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') AS shown FROM customer")
def minutes_shown(spark, d):
    return table(spark, d, "customer").select("c_custkey", dates.minutes_text(F.col("c_custkey") * 1000 + 999).alias("shown"))


# Texts and labels


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'self,first,x,convertedFrom' ELSE ',self,http://opds-spec.org/acquisition/open-access,http://opds-spec.org/acquisition' END AS rels FROM customer")
def ordered_links(spark, d):
    link = lambda rel: F.struct(F.lit(rel).alias("rel"), F.lit("/h").alias("href"), F.col("c_name").alias("title"))
    even = F.array(link("x"), link("convertedFrom"), link("self"), link("first"))
    odd = F.array(link("http://opds-spec.org/acquisition"), link("self"), link("http://opds-spec.org/acquisition/open-access"), link(""))
    got = text.sanitized_links(F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(got, lambda x: x["rel"]), ",").alias("rels"))


@query("SELECT c_custkey, 'http://b.example/resources/customer/store/' || replace(c_name, '#', '%23') AS url, 'http://b.example/' || CAST(c_custkey AS VARCHAR) || '/x' AS joined FROM customer")
def record_urls(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.record_url("http://b.example/", F.lit("customer"), F.lit("store"), F.col("c_name")).alias("url"), text.joined_uri(F.lit("http://b.example/"), F.concat(F.lit("/"), _key("c_custkey")), F.lit("/x/")).alias("joined"))


@query("SELECT c_custkey, 'Customer ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' , ' || c_mktsegment || ' !' AS tokens, 'a\\n' || c_mktsegment AS escaped FROM customer")
def tokens_and_escapes(spark, d):
    raw = F.concat(F.lit("<b>"), "c_name", F.lit("</b>,  "), "c_mktsegment", F.lit("!"))
    return table(spark, d, "customer").select("c_custkey", text.tokenized(raw).alias("tokens"), text.escaped_unprintable(F.concat(F.lit("a\n"), "c_mktsegment")).alias("escaped"))


@query("SELECT c_custkey, CAST(c_custkey % 999 + 1 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '.5 kB' ELSE '.0 MB' END AS shown FROM customer")
def pretty_sizes(spark, d):
    k = F.col("c_custkey") % 999 + 1
    size = F.when(F.col("c_custkey") % 2 == 0, k * 1000 + 500).otherwise(k * 1_000_000)
    return table(spark, d, "customer").select("c_custkey", text.pretty_bytes(size).alias("shown"))


@query("SELECT c_custkey, substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) AS id, md5(c_name) AS bare FROM customer")
def record_uuids(spark, d):
    own = text.uuid_text(text.content_hash(F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", own.alias("id"), text.bare_uuid(F.upper(own)).alias("bare"))


@query("SELECT p_partkey, 'brand' || replace(replace(p_brand, '#', ''), 'Brand', 'Brand') AS camel, CASE WHEN p_partkey % 2 = 0 THEN 'categories' ELSE 'boxes' END AS plural FROM part")
def camel_and_plural(spark, d):
    return table(spark, d, "part").select("p_partkey", text.camel_case(F.concat(F.lit("brand_"), F.replace("p_brand", F.lit("#"), F.lit("")))).alias("camel"), text.plural(F.when(F.col("p_partkey") % 2 == 0, "category").otherwise("box")).alias("plural"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{\"name\":\"' || c_name || '\",\"deep\":{\"list\":[1]}}' ELSE '{\"name\":\"' || c_name || '\"}' END AS cleaned FROM customer")
def cleaned_json(spark, d):
    inner = F.when(F.col("c_custkey") % 2 == 0, '{"list": [1, "", {}], "date": "0000-00-00"}').otherwise('{"list": [[], {"x": null}]}')
    raw = F.concat(F.lit('{"name": "'), "c_name", F.lit('", "none": null, "blank": " ", "api secret": "s", "deep": '), inner, F.lit("}"))
    return table(spark, d, "customer").select("c_custkey", text.clean_json(raw).alias("cleaned"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Russian|France|Editor' WHEN 1 THEN 'German|Poland|Author' ELSE 'zzz|zz|zzz' END AS labels, CASE n_nationkey % 3 WHEN 0 THEN 'Книга' ELSE 'Book' END AS name FROM nation")
def code_labels(spark, d):
    k = F.col("n_nationkey") % 3
    pick = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    labels = [vocabulary.translated(pick(*codes), names) for codes, names in ((("rus", "ger", "zzz"), vocabulary.LANGUAGES), (("fr", "pl", "zz"), vocabulary.COUNTRIES), (("edt", "aut", "zzz"), vocabulary.RELATORS))]
    name = text.localized(F.create_map(F.lit("ru"), F.lit("Книга"), F.lit("en"), F.lit("Book")), pick("ru", "de", "en"))
    return table(spark, d, "nation").select("n_nationkey", F.concat_ws("|", *labels).alias("labels"), name.alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE least(10000, greatest(1, o_orderkey - 500)) END AS n FROM orders")
def page_sizes(spark, d):
    """Sizes of pages asked for, some of them not given, too small or too large."""
    asked = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") - 500)
    return table(spark, d, "orders").select("o_orderkey", S.page_sizes(asked).alias("n"))
