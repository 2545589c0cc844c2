"""The catalogue's queries over linking entries, counts that heed deletions, deletes on stored tables, and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .format_queries import LEADER, _marc, _scratch
from .functions import marc as M
from .functions import text
from .operators import ingest, leaves, neighbours, stats, stored
from .operators import store as S
from .plans import linking
from .queries import query
from .sources import marc, php, tsv
from .sources.tables import graph, spread, table

# Linking entries

#: What SQL says of a part: the record before it, the one after it and the book it is in, with indicators that follow its size.
_LINKS = """
    SELECT p_partkey, '780' AS tag, CAST(p_size % 10 AS VARCHAR) AS ind2, CAST(p_partkey + 1 AS VARCHAR) AS w FROM part
    UNION ALL SELECT p_partkey, '785', CASE WHEN p_size % 3 = 0 THEN ' ' ELSE CAST(p_size % 10 AS VARCHAR) END, '(Nlr) ' || CAST(p_partkey * 3 AS VARCHAR) FROM part
    UNION ALL SELECT p_partkey, '773', ' ', p_brand FROM part
"""
_KINDS = """CASE WHEN tag = '773' THEN 'partOf'
    WHEN tag = '780' THEN CASE ind2 WHEN '0' THEN 'continues' WHEN '1' THEN 'continuesInPart' WHEN '4' THEN 'mergerOf' WHEN '5' THEN 'absorbed' WHEN '6' THEN 'absorbed' WHEN '7' THEN 'separatedFrom' ELSE 'precededBy' END
    ELSE CASE ind2 WHEN '0' THEN 'continuedBy' WHEN '1' THEN 'continuedInPartBy' WHEN '4' THEN 'absorbedBy' WHEN '5' THEN 'absorbedBy' WHEN '6' THEN 'splitInto' WHEN '7' THEN 'mergedToForm' WHEN '8' THEN 'continuedBy' ELSE 'succeededBy' END END"""
_SQL_EDGES = f"""SELECT CAST(p_partkey AS VARCHAR) AS key_from, {_KINDS} AS relation_kind, CASE WHEN tag = '785' THEN 'rusprnb' ELSE 'liba' END AS source_to,
    CASE WHEN tag = '785' THEN CAST(p_partkey * 3 AS VARCHAR) ELSE lower(w) END AS key_to FROM ({_LINKS}) links"""
_SQL_ANCHORS = """SELECT 'instance' AS kind, 'liba' AS source, CAST(p_partkey AS VARCHAR) AS key FROM part UNION SELECT 'collection', 'liba', lower(p_brand) FROM part WHERE p_size > 10
    UNION SELECT 'item', 'rusprnb', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size % 2 = 0 UNION SELECT 'agent', 'rusprnb', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size % 4 = 0"""


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records that name the record before them, after them and the whole they are part of."""
    digit = lambda n: (F.col("p_size") % n).cast("string")
    key = lambda c: c.cast("string")
    rec = _marc(LEADER, {"001": key(F.col("p_partkey")), "003": F.lit("LibA")}, [
        ("780", "0", "x", {"w": key(F.col("p_partkey") + 1)}), ("785", "0", "y", {"t": F.col("p_name"), "w": F.concat(F.lit("(Nlr) "), key(F.col("p_partkey") * 3))}),
        ("773", "0", " ", {"w": F.col("p_brand")}), ("245", "0", "0", {"w": F.lit("no link")}), ("787", "0", " ", {"t": F.lit("no number"), "w": F.lit(" ")}),
    ])
    second = {"x": digit(10), "y": F.when(F.col("p_size") % 3 == 0, " ").otherwise(digit(10))}
    other = lambda f: F.coalesce(*[F.when(f["ind2"] == mark, value) for mark, value in second.items()], f["ind2"])
    fields = F.transform(F.col("marc.datafield"), lambda f: f.withField("ind2", other(f)))
    return spread(table(spark, d, "part"), "p_partkey").withColumn("marc", rec).withColumn("marc", F.col("marc").withField("datafield", fields)).select("marc", F.col("p_partkey").alias("pos"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of all parts, of most of their brands and, under another library, of some parts of one or two kinds."""
    own = table(spark, d, "part")
    node = lambda rows, kind, source, key: rows.select(F.lit(kind).alias("kind"), F.lit(source).alias("source"), key.cast("string").alias("key"))
    found = node(own, "instance", "liba", F.col("p_partkey")).unionByName(node(own.where("p_size > 10"), "collection", "liba", F.lower("p_brand")))
    for kind, n in (("item", 2), ("agent", 4)):
        found = found.unionByName(node(own.where(F.col("p_size") % n == 0), kind, "rusprnb", F.col("p_partkey")))
    return found.distinct()


@query(_SQL_EDGES)
def linking_relations(spark, d):
    """Edges of three tags with all their second indicators; fields without a number give none."""
    return linking.linking_edges(_linked(spark, d)).select("key_from", "relation_kind", "source_to", "key_to")


@query(f"""WITH edges AS ({_SQL_EDGES}), anchors AS ({_SQL_ANCHORS}) SELECT key_from, relation_kind, e.source_to, e.key_to,
    coalesce(CASE WHEN count(*) FILTER (kind = 'instance') > 0 THEN 'instance' ELSE min(kind) END, 'instance') AS kind_to, count(kind) > 0 AS found
    FROM edges e LEFT JOIN anchors a ON a.source = e.source_to AND a.key = e.key_to GROUP BY key_from, relation_kind, e.source_to, e.key_to""")
def linking_resolved(spark, d):
    """Their targets, of the record's own kind or of another."""
    return linking.resolved(linking.linking_edges(_linked(spark, d)), _known(spark, d)).select("key_from", "relation_kind", "source_to", "key_to", "kind_to", "found")


@query(f"""WITH edges AS ({_SQL_EDGES}), anchors AS ({_SQL_ANCHORS}) SELECT relation_kind, source_to, count(*) AS missing, count(DISTINCT key_to) AS targets
    FROM edges e WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.source = e.source_to AND a.key = e.key_to) GROUP BY 1, 2""")
def linking_unresolved(spark, d):
    """Numbers that no anchor has."""
    return linking.unresolved(linking.linking_edges(_linked(spark, d)), _known(spark, d))


# Counts that heed deletions


def _settled(spark: SparkSession, d: str) -> stats.Ledger:
    """All rows imported, customers and the details of clicks deleted, some of them imported again; a batch twice, a sum between."""
    store, ledger = graph(spark, d), stats.Ledger(spark, _scratch(spark, "ledger"))
    ledger.record(1, added=store)
    gone, clicks = ingest.removal(store, "customer"), ingest.removal(store, "event", "click")
    ledger.record(2, removed=gone)
    ledger.record(3, removed=clicks)
    ledger.record(3, removed=clicks)
    ledger.compact(2)
    again = S.GraphStore(gone.anchors, clicks.details.where(F.col("key").cast("long") % 2 == 0), gone.relations.where("kind_to = 'orders' AND serial % 3 = 0"))
    ledger.record(4, added=again)
    return ledger


@query("SELECT event_type AS source, 'p' || CAST(user_id % 3 AS VARCHAR) AS provider, date_trunc('day', ts) AS since, count(*) AS cnt FROM events WHERE event_type <> 'click' OR user_id % 2 = 0 GROUP BY 1, 2, 3")
def ledger_of_details(spark, d):
    """Daily counts after import, deletion and another import, from changes only."""
    return _settled(spark, d).daily()[0].select("source", "provider", "since", "cnt")


@query("""SELECT 'customer' AS kind_from, 'orders' AS kind_to, date_trunc('day', o_orderdate) AS since, count(*) AS cnt FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 3
    UNION ALL SELECT 'region', 'nation', NULL, count(*) FROM nation UNION ALL SELECT 'nation', 'supplier', NULL, count(*) FROM supplier""")
def ledger_of_relations(spark, d):
    """Edges to and from the deleted customers are off the counts, those imported again are on them."""
    return _settled(spark, d).daily()[1].select("kind_from", "kind_to", "since", "cnt")


@query("""SELECT 'anchors' AS name, 'orders' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'anchors', 'part', count(*) FROM part UNION ALL SELECT 'anchors', 'nation', count(*) FROM nation
    UNION ALL SELECT 'anchors', 'region', count(*) FROM region UNION ALL SELECT 'anchors', 'supplier', count(*) FROM supplier UNION ALL SELECT 'details', 'event', count(*) FROM events
    UNION ALL SELECT 'relations', 'region', count(*) FROM nation UNION ALL SELECT 'relations', 'nation', count(*) FROM supplier""")
def deleted_from_store(spark, d):
    """What a stored graph holds after its customers are deleted: partitions of other kinds are left as they are."""
    path = _scratch(spark, "store")
    graph(spark, d).write(path)
    stored.delete_stored(spark, path, "customer")
    left = S.GraphStore.read(spark, path)
    rows = None
    for name, kind in (("anchors", "kind"), ("details", "kind"), ("relations", "kind_from")):
        own = getattr(left, name).groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "kind", "n")
        rows = own if rows is None else rows.unionByName(own)
    return rows


# Nested records


def _orders_json(spark: SparkSession, d: str) -> DataFrame:
    """Orders as objects five levels deep, with lists of one to three and of lists."""
    word = lambda n: F.get(F.split("o_orderpriority", "-"), F.lit(n))
    part = F.struct(F.struct(F.struct(F.col("o_orderstatus").alias("code"), F.array(F.array(word(0), word(1))).alias("words")).alias("state")).alias("of"))
    deep = F.struct(
        F.col("o_orderkey").alias("id"), F.struct(F.array_repeat(part, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("parts"), F.col("o_totalprice").alias("price")).alias("record"),
        F.when(F.col("o_custkey") % 2 == 0, F.struct(F.struct(F.col("o_custkey").alias("key")).alias("customer"))).alias("by"),
    )
    return spread(table(spark, d, "orders"), "o_orderkey").select(F.to_json(deep).alias("json"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS code, CAST(o_orderkey % 3 + 1 AS INTEGER) AS n, split_part(o_orderpriority, '-', 2) AS word,
    CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS customer FROM orders""")
def tsv_leaf_round_trip(spark, d):
    """Written with a column for each leaf path and built up again by path."""
    path = _scratch(spark, "leaves")
    leaves.write_leaf_tsv(_orders_json(spark, d), "json", path)
    rows = leaves.nested_records(tsv.read_tsv(spark, path))
    last = "id string, record struct<parts:array<struct<of:struct<state:struct<code:string,words:array<array<string>>>>>>>, by struct<customer:struct<key:string>>"
    r = rows.select(F.from_json("record", last).alias("r")).select("r.*")
    end = F.element_at("record.parts", -1)["of"]["state"]
    return r.select("id", end["code"].alias("code"), F.size("record.parts").alias("n"), end["words"][0][1].alias("word"), F.col("by.customer.key").alias("customer"))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(['id', 'record.price', 'record.parts.0.of.state.code', 'record.parts.0.of.state.words.0.1'] || CASE WHEN o_orderkey % 3 = 2 THEN ['record.parts.2.of.state.words.0.0'] ELSE CAST([] AS VARCHAR[]) END) AS name FROM orders) t GROUP BY 1")
def leaf_occurrences(spark, d):
    """How often a leaf path occurs in nested records."""
    wanted = ["id", "record.price", "record.parts.0.of.state.code", "record.parts.0.of.state.words.0.1", "record.parts.2.of.state.words.0.0"]
    name = F.array_join("steps", ".").alias("name")
    return leaves.leaves(_orders_json(spark, d), "json", []).select(name).where(F.col("name").isin(wanted)).groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS price, arg_max(o_orderpriority, o_orderkey) AS priority, arg_max(o_orderstatus = 'F', o_orderkey) AS finished,
    string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1""")
def merged_records(spark, d):
    """Reports of single orders merged to one of each customer: counts and prices add up at any depth, keys are joined, the last priority stays."""
    one = F.struct(
        F.lit(1).alias("n"), F.struct(F.struct(F.col("o_totalprice").cast("decimal(20,2)").alias("sum")).alias("price"), F.create_map(F.col("o_orderstatus"), F.lit(1)).alias("of")).alias("totals"),
        F.struct(F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("finished")).alias("last"), F.array("o_orderkey").alias("keys"),
    )
    rows = spread(table(spark, d, "orders"), "o_orderkey").select("o_custkey", "o_orderkey", F.to_json(one).alias("json"))
    merged = leaves.merged_objects(rows, "json", ["o_custkey"], "o_orderkey")
    shape = "n long, totals struct<price:struct<sum:decimal(38,2)>,of:map<string,long>>, last struct<priority:string,finished:boolean>, keys array<long>"
    m = merged.select("o_custkey", F.from_json("merged", shape).alias("m")).select("o_custkey", "m.*")
    of = lambda c: F.coalesce(F.try_element_at("totals.of", F.lit(c)), F.lit(0))
    return m.select("o_custkey", "n", F.col("totals.price.sum").cast("double").alias("price"), "last.priority", "last.finished", F.array_join("keys", ",").alias("keys"), of("F").alias("f"), of("O").alias("o"))


# Nearest vectors


def _indexed(spark: SparkSession, d: str) -> tuple[neighbours.VectorIndex, DataFrame, int]:
    """All vectors in as many lists as the root of their number, those whose id is divisible by 100 as queries."""
    rows = table(spark, d, "embeddings")
    lists = max(4, int(rows.count() ** 0.5))
    return neighbours.VectorIndex.build(rows, _scratch(spark, "vectors"), lists=lists), rows.where("vec_id % 100 = 0"), lists


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS u FROM embeddings), p AS (SELECT q.vec_id AS query, e.vec_id AS id, array_cosine_similarity(q.u, e.u) AS c FROM e q, e WHERE q.vec_id % 100 = 0)
    SELECT query, id, rank, round(1 - c, 5) + 0.0 AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY 1 - c, id) - 1 AS INTEGER) AS rank FROM p) r WHERE rank < 10""")
def indexed_neighbours(spark, d):
    """A search of all lists of the index finds the exact neighbours."""
    index, queries, lists = _indexed(spark, d)
    return index.search(queries, 10, lists).select("query", "id", "rank", (F.round("distance", 5) + 0.0).alias("distance"))


@query()
def approximate_neighbours(spark, d):
    """A search of half of the lists."""
    index, queries, lists = _indexed(spark, d)
    return index.search(queries, 10, max(4, lists // 2))


# Bytes


_CHARSETS = ("UTF-8", "UTF-16LE", "windows-1251")


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records with a Cyrillic title, which every charset here has."""
    key = F.col("p_partkey").cast("string")
    rec = _marc(LEADER, {"001": key, "003": F.lit("LibA")}, [("245", "0", "0", {"a": F.concat(F.lit("Книга Нова №"), key), "b": F.col("p_type")}), ("260", " ", " ", {"b": F.concat(F.col("p_brand"), F.lit(" Н"))})])
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", rec.alias("marc"))


@query("SELECT p_partkey, ['UTF-8', 'UTF-16LE', 'windows-1251'][1 + p_partkey % 3] AS charset, 'Книга Нова №' || CAST(p_partkey AS VARCHAR) AS title, p_type AS rest, p_brand || ' Н' AS publisher, CAST(NULL AS VARCHAR) AS damage FROM part")
def iso2709_charsets(spark, d):
    """Records written in three charsets, a file of each, and read by bytes: signs that hold a mark's byte stay whole."""
    found = None
    for k, charset in enumerate(_CHARSETS):
        raw = _titled(spark, d).where(F.col("p_partkey") % 3 == k).select(marc.encoded(marc.to_iso2709(F.col("marc"), charset), charset).alias("raw"))
        end = "\x1d\x00" if charset == "UTF-16LE" else "\x1d"
        path = _scratch(spark, "charset")
        # The writer ends each record with its mark.
        raw.select(F.substring("raw", F.lit(1), F.octet_length("raw") - len(end)).cast("string").alias("value")).write.option("lineSep", end).text(path)
        rows = marc.read_marc(spark, path, "UTF-16LE") if charset == "UTF-16LE" else marc.read_marc(spark, path, other=None if charset == "UTF-8" else charset)
        m = F.col("marc")
        own = rows.select(M.control(m, "001").cast("long").alias("p_partkey"), F.lit(charset).alias("charset"), M.first(m, "245", "a").alias("title"), M.first(m, "245", "b").alias("rest"), M.first(m, "260", "b").alias("publisher"), "damage")
        found = own if found is None else found.unionByName(own)
    return found


@query("SELECT ['length', 'base', 'directory', 'field', NULL][1 + p_partkey % 5] AS damage, count(*) AS n FROM part GROUP BY 1")
def iso2709_rejects(spark, d):
    """Records with a wrong length, base address, directory or place of a field, and sound ones."""
    iso, k = marc.to_iso2709(F.col("marc")), F.col("p_partkey") % 5
    told = lambda c, a, text: F.overlay(c, F.lit(text), F.lit(a))
    broken = F.when(k == 0, F.concat(iso, F.lit("x" * 9))).when(k == 1, told(iso, 13, "00x00")).when(k == 2, told(iso, 28, "a")).when(k == 3, told(iso, 32, "9")).otherwise(iso)
    return _titled(spark, d).select(marc.damage(broken).alias("damage")).groupBy("damage").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey * 100000007 + l_linenumber AS n FROM lineitem)
    SELECT n, string_agg(CASE WHEN n >= p THEN substr('123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ', CAST(n // p % 58 AS INTEGER) + 1, 1) ELSE '' END, '' ORDER BY p DESC) AS text
    FROM e, (SELECT CAST(58 ** unnest(range(9)) AS BIGINT) AS p) GROUP BY n""")
def base58_numbers(spark, d):
    n = F.col("l_orderkey").cast("long") * 100_000_007 + F.col("l_linenumber").cast("long")
    return table(spark, d, "lineitem").select(n.alias("n")).distinct().select("n", text.base58_number(F.col("n")).alias("text"))


@query("""SELECT o_orderkey, CAST(2 + o_orderkey % 3 AS INTEGER) AS n, 'Абзац "1"; {' || o_orderpriority || '}' AS first, 'конец ' || CAST(o_custkey AS VARCHAR) AS last, CAST(o_custkey % 7 AS VARCHAR) AS note FROM orders""")
def php_bodies(spark, d):
    """URL-encoded serialised arrays of arrays of texts, as articles' bodies are, with signs of the format within the texts."""
    text_of = lambda c: F.concat(F.lit("s:"), F.octet_length(c).cast("string"), F.lit(':"'), c, F.lit('";'))
    entry = lambda k, c: F.concat(F.lit("i:"), k.cast("string"), F.lit(';a:2:{s:4:"text";'), text_of(c), F.lit('s:9:"footnotes";a:1:{i:0;a:1:{s:1:"n";i:'), (F.col("o_custkey") % 7).cast("string"), F.lit(";}}}"))
    middle = F.col("o_orderkey") % 3
    words = F.concat(F.array(F.concat(F.lit('Абзац "1"; {'), "o_orderpriority", F.lit("}"))), F.array_repeat(F.lit(""), middle.cast("int")), F.array(F.concat(F.lit("конец "), F.col("o_custkey").cast("string"))))
    body = F.concat(F.lit("a:"), F.size(words).cast("string"), F.lit(":{"), F.array_join(F.transform(words, lambda w, i: entry(i, w)), ""), F.lit("}"))
    rows = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey").select("o_orderkey", F.url_encode(body).alias("body"))
    found = rows.select("o_orderkey", php.leaves(F.url_decode("body")).alias("l")).select("o_orderkey", php.texts(F.col("l"), "text").alias("p"), "l")
    note = F.element_at(F.filter("l", lambda x: F.element_at(x["path"], -1) == "n"), 1)["value"]
    return found.select("o_orderkey", F.size("p").alias("n"), F.get("p", F.lit(0)).alias("first"), F.element_at("p", -1).alias("last"), note.alias("note"))
