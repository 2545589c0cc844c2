"""JSON and XML feeds: OPDS publications, Atom entries, publishers' books, journals, registry dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import host_and_path, let, parse_identifier, sanitize_kind
from . import php
from .registry import ATOM, JES, LITRES, OPDS, read_xml_records

OPDS_SCHEMA = (
    "metadata struct<identifier: string, `@type`: string, modified: string, issn: string, title: string>, "
    "links array<struct<rel: string, href: string, type: string, title: string>>, images array<struct<href: string, type: string>>"
)


def opds_tuples(records: DataFrame, record: str = "record", source: str | None = None) -> DataFrame:
    """Tuples of OPDS 2 publications held as JSON text, an edge from the periodical for those with an ISSN."""
    p = F.from_json(F.col(record), OPDS_SCHEMA)
    kind = F.coalesce(sanitize_kind(F.element_at(F.split(p["metadata"]["@type"], "/"), -1)), F.lit("publication"))
    ident = parse_identifier(F.regexp_replace(p["metadata"]["identifier"], "(?i)^urn:", ""))
    base = records.select(F.col(record).alias("record"), p.alias("p"), kind.alias("kind"), F.coalesce(ident["source"], F.lit(source)).alias("source"), F.coalesce(ident["key"], p["metadata"]["identifier"]).alias("key"))
    stamp = F.try_to_timestamp("p.metadata.modified").cast("timestamp_ntz")
    own = base.select("kind", "source", "key", "record", F.lit(OPDS).alias("media_type"), stamp.alias("time_source"))
    edges = base.where("p.metadata.issn IS NOT NULL").select(
        F.lit("periodical").alias("kind_from"), F.lit("issn").alias("source_from"), F.col("p.metadata.issn").alias("key_from"), F.lit("hasPart").alias("relation_kind"),
        F.col("kind").alias("kind_to"), F.col("source").alias("source_to"), F.col("key").alias("key_to"), stamp.alias("time_source"),
    )
    return own.unionByName(edges, allowMissingColumns=True)


ATOM_SCHEMA = (
    "id string, title string, updated string, published string, summary string, author array<struct<name: string>>, "
    "link array<struct<_href: string, _rel: string, _type: string, _title: string>>, category array<struct<_term: string, _label: string>>"
)


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    return read_xml_records(spark, path, ATOM, ATOM_SCHEMA)


def atom_tuples(entries: DataFrame) -> DataFrame:
    """Tuples of Atom entries: host and path of the id as the node."""
    node = host_and_path(F.col("id"))
    return entries.select(
        F.lit("publication").alias("kind"), F.when(node["source"] != "", node["source"]).otherwise("urn").alias("source"), F.when(node["key"] != "", node["key"]).otherwise(F.col("id")).alias("key"),
        F.to_json(F.struct("*")).alias("record"), F.lit(ATOM).alias("media_type"), F.try_to_timestamp("updated").cast("timestamp_ntz").alias("time_source"),
    )


BOOK_SCHEMA = (
    "_id string, _external_id string, _updated string, _allow_sell int, _lang string, _type int, _chars long, _rating double, _price double, "
    "`title-info` struct<`book-title`: string, annotation: string, date: string, genre: array<struct<_VALUE: string, _token: string>>, "
    "author: array<struct<`first-name`: string, `last-name`: string, relation: string>>, sequence: array<struct<_name: string, _number: string>>>, "
    "sequences struct<sequence: array<struct<_name: string, _number: string>>>"
)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return read_xml_records(spark, path, LITRES, BOOK_SCHEMA)


def read_removed_books(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, removed) of books that a publisher took back."""
    rows = spark.read.format("xml").option("rowTag", "removed-book").schema("_id string, _external_id string, _removed string").load(path)
    return rows.select(F.coalesce("_external_id", "_id").alias("key"), F.try_to_timestamp("_removed").cast("timestamp_ntz").alias("removed")).where("key IS NOT NULL")


def book_tuples(books: DataFrame, source: str = "litres") -> DataFrame:
    return books.select(
        F.lit("book").alias("kind"), F.lit(source).alias("source"), F.coalesce("_external_id", "_id").alias("key"), F.to_json(F.struct("*")).alias("record"),
        F.lit(LITRES).alias("media_type"), F.try_to_timestamp("_updated").cast("timestamp_ntz").alias("time_source"),
    ).where("key IS NOT NULL")


def book_publication(b: Column) -> Column:
    """A publisher's book as a publication; the size counts seconds, characters or pages by type."""
    info = b["title-info"]
    name = lambda a: F.concat_ws(" ", a["first-name"], a["last-name"])
    return F.struct(
        info["book-title"].alias("title"), info["annotation"].alias("description"), b["_rating"].alias("rating"), (b["_allow_sell"] > 0).alias("available"), b["_lang"].alias("language"),
        F.transform(info["author"], name).alias("author"), F.transform(info["genre"], lambda g: g["_token"]).alias("subject"), F.transform(info["sequence"], lambda s: s["_name"]).alias("series"),
        F.when(b["_type"] == 1, b["_chars"]).alias("duration"), F.when(b["_type"] == 0, b["_chars"]).alias("extent"), F.when(b["_type"] == 4, b["_chars"]).alias("numberOfPages"),
    )


JOURNAL_SCHEMA = (
    "issn string, title string, issues struct<issue: array<struct<product_id: string, date_public: long, "
    "articles: struct<article: array<struct<external_pid: string, title: string, text: string>>>>>>"
)


def article_paragraphs(body: Column) -> Column:
    """The texts of an article's body, a URL-encoded serialised PHP array of arrays, in order; null if it isn't one."""
    return php.texts(php.leaves(F.try_url_decode(body)), "text")


def read_journals(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Journals (issn, title, issues) of XML files, in UTF-16 with a byte order mark; texts may be URL-encoded. Articles bring the paragraphs of their bodies."""
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    # Bodies of all issues are one list, in which an issue's begin behind those of the issues before it.
    bodies = F.flatten(F.transform("issues.issue", lambda i: F.transform(F.coalesce(i["articles"]["article"], F.array()), lambda a: F.try_url_decode(a["text"]))))
    rows = read_xml_records(spark, path, JES, JOURNAL_SCHEMA, encoding).withColumn("bodies", php.leaves_of_each(bodies))
    count = lambda i: F.coalesce(F.size(i["articles"]["article"]), F.lit(0))
    before = lambda n: F.aggregate(F.slice("issues.issue", F.lit(1), n), F.lit(0), lambda s, i: s + F.greatest(count(i), F.lit(0)))
    article = lambda start: lambda a, k: F.struct(a["external_pid"].alias("external_pid"), plain(a["title"]).alias("title"), php.texts(F.get("bodies", start + k), "text").alias("paragraphs"))
    articles = lambda i, n: let(before(n), lambda start: F.transform(i["articles"]["article"], article(start)))
    issue = lambda i, n: F.struct(i["product_id"].alias("product_id"), i["date_public"].alias("date_public"), articles(i, n).alias("articles"))
    return rows.select("issn", plain(F.col("title")).alias("title"), F.transform("issues.issue", issue).alias("issues"))


def read_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a registry dump, one JSON object of arrays a file: copies, parts, items, users, directories."""
    whole = spark.read.option("multiLine", True).json(path)
    return {name: whole.select(F.explode(name).alias("r")).select("r.*") for name in ("copies", "parts", "items", "users", "directories")}


def journal_tuples(journals: DataFrame) -> DataFrame:
    """Tuples of journals (issn, issues[product_id, date_public, articles[external_pid, title]])."""
    issue = journals.select("issn", F.explode("issues").alias("i"))
    article = issue.select("issn", "i.product_id", F.timestamp_seconds("i.date_public").cast("timestamp_ntz").alias("time_source"), F.explode("i.articles").alias("a"))
    node = lambda kind, key, rec: [F.lit(kind).alias("kind"), F.lit("jes").alias("source"), key.alias("key"), F.to_json(rec).alias("record"), F.lit(JES).alias("media_type")]
    edge = lambda a, ka, b, kb: [F.lit(a).alias("kind_from"), F.lit("jes").alias("source_from"), ka.alias("key_from"), F.lit("hasPart").alias("relation_kind"), F.lit(b).alias("kind_to"), F.lit("jes").alias("source_to"), kb.alias("key_to")]
    date = F.timestamp_seconds("i.date_public").cast("timestamp_ntz").alias("time_source")
    parts = [
        journals.select(*node("periodical", F.col("issn"), F.struct("issn", "title"))),
        issue.select(*node("publication_issue", F.col("i.product_id"), F.struct("i.product_id", "i.date_public")), date),
        issue.select(*edge("periodical", F.col("issn"), "publication_issue", F.col("i.product_id")), date),
        article.select(*node("scholarly_article", F.col("a.external_pid"), F.col("a")), "time_source"),
        article.select(*edge("publication_issue", F.col("product_id"), "scholarly_article", F.col("a.external_pid")), "time_source"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def card_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Table rows of HTML pages as arrays of cell texts, in order."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")))
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(rows).alias("row", "r")).withColumn("cells", cells(F.col("r"))).drop("r")
