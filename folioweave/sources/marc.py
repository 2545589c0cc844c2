"""MARC: the ISO 2709 exchange format as expressions, MARCXML through Spark's XML reader, tuples.

A record is a 24-character leader, a directory of entries of twelve digits (tag, length, start) up to
the first field mark, and the fields at byte offsets from the leader's base address. Records are held as
binary, so offsets stay byte offsets whatever the text's encoding.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import marc as M
from ..functions.text import let
from ..model import MARC_RECORD
from ..plans.linking import linking_edges, linking_tuples
from .registry import MARC, MARCXML, ROW_TAG

FIELD_MARK, SUBFIELD_MARK = "\x1e", "\x1f"
_STRUCT = MARC_RECORD.simpleString()


def _high(charset: str) -> tuple[str, str]:
    """The 128 signs of a one-byte charset's upper half, and what a Latin-1 reading makes of their bytes; bytes without a sign are left out."""
    pairs = [(bytes([k]).decode(charset, "replace"), chr(k)) for k in range(128, 256)]
    return "".join(x for x, _ in pairs if x != "\ufffd"), "".join(y for x, y in pairs if x != "\ufffd")


def _wide(charset: str) -> bool:
    return charset.upper().startswith("UTF-16")


def decoded(raw: Column, charset: str = "UTF-8") -> Column:
    """Bytes as text: UTF-8 with broken bytes replaced, UTF-16LE or UTF-16BE without the last byte of an odd number, or a one-byte charset that Python knows."""
    if charset.upper() in ("UTF-8", "UTF8"):
        return F.make_valid_utf8(raw.cast("string"))
    if _wide(charset):
        return F.decode(F.substring(raw, F.lit(1), F.octet_length(raw) - F.octet_length(raw) % 2), charset)
    signs, bytes_of = _high(charset)
    return F.translate(F.decode(raw, "ISO-8859-1"), bytes_of, signs)


def encoded(text: Column, charset: str = "UTF-8") -> Column:
    """Text as bytes; what a one-byte charset lacks becomes a question mark."""
    if charset.upper() in ("UTF-8", "UTF8") or _wide(charset):
        return F.encode(text, charset)
    signs, bytes_of = _high(charset)
    kept = F.regexp_replace(text, "[^\\x00-\\x7f" + re.escape(signs) + "]", "?")
    return F.encode(F.translate(kept, signs, bytes_of), "ISO-8859-1")


def _framed(raw: Column, charset: str, then: Callable[[Column], Column]) -> Column:
    """``then`` of a record's leader, base address, number of directory entries, and its array of (tag, size, start), sizes and places in bytes.

    Each is worked out once; ``raw`` has to be bound, as it is looked into for every entry.
    """
    unit = 2 if _wide(charset) else 1
    ascii_text = lambda a, n: decoded(F.substring(raw, a * unit + 1, F.lit(n * unit)), charset if unit == 2 else "UTF-8")
    entry = lambda x: F.struct(F.substring(x, 1, 3).alias("tag"), F.substring(x, 4, 4).try_cast("int").alias("size"), F.substring(x, 8, 5).try_cast("int").alias("start"))
    # The directory has 10,000 entries at most; an entry is read by its bytes' place.
    listed = lambda n: F.transform(F.sequence(F.lit(0), F.least(F.greatest(n, F.lit(1)), F.lit(10_000)) - 1), lambda i: let(ascii_text(24 + i * 12, 12), entry))
    head = lambda leader: F.struct(leader.alias("leader"), F.substring(leader, 13, 5).try_cast("int").alias("base"))
    counted = lambda h: F.struct(h["leader"].alias("leader"), h["base"].alias("base"), ((h["base"] - 25 * unit) / (12 * unit)).cast("int").alias("n"))
    whole = lambda h: F.struct(h["leader"].alias("leader"), h["base"].alias("base"), F.when((h["base"] > 25 * unit) & (h["n"] > 0), listed(h["n"])).alias("entries"))
    return let(ascii_text(F.lit(0), 24), lambda x: let(head(x), lambda h: let(counted(h), lambda c: let(whole(c), then))))


def parsed(record: Column, charset: str = "UTF-8", other: str | None = None) -> Column:
    """The record struct of an ISO 2709 text or binary; null where the leader or directory can't be read.

    Records are taken apart as bytes, by the places in their directory, and each field is decoded by itself: by ``charset``, or, where
    ``other`` is given and the leader doesn't say that the record is Unicode ("a" at its place 9), by that. In UTF-16 leader,
    directory and marks take two bytes a sign.
    """
    def read(raw: Column, frame: Column) -> Column:
        unicode = F.substring(frame["leader"], 10, 1) == "a"
        text = lambda x: decoded(x, charset) if other is None else F.when(unicode, decoded(x, charset)).otherwise(decoded(x, other))
        body = lambda e: F.replace(text(F.substring(raw, frame["base"] + e["start"] + 1, e["size"])), F.lit(FIELD_MARK), F.lit(""))
        found = F.filter(F.transform(frame["entries"], lambda e: F.struct(e["tag"].alias("tag"), body(e).alias("body"))), lambda e: e["body"].isNotNull())
        return let(found, lambda fields: F.struct(frame["leader"].alias("leader"), F.transform(F.filter(fields, lambda e: F.startswith(e["tag"], F.lit("00"))), lambda e: F.struct(e["tag"].alias("tag"), e["body"].alias("value"))).alias("controlfield"),
                                                  F.transform(F.filter(fields, lambda e: ~F.startswith(e["tag"], F.lit("00"))), field).alias("datafield")))

    def field(e: Column) -> Column:
        return let(F.split(e["body"], SUBFIELD_MARK), lambda parts: of_parts(e, parts))

    def of_parts(e: Column, parts: Column) -> Column:
        subs = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: p != ""), lambda p: F.struct(F.substring(p, 1, 1).alias("code"), F.substr(p, F.lit(2)).alias("value")))
        lead = F.get(parts, F.lit(0))
        return F.struct(e["tag"].alias("tag"), F.substring(lead, 1, 1).alias("ind1"), F.substring(lead, 2, 1).alias("ind2"), subs.alias("subfield"))

    return let(record.cast("binary"), lambda raw: _framed(raw, charset, lambda f: F.when(f["entries"].isNotNull(), read(raw, f)))).cast(_STRUCT)


def damage(record: Column, charset: str = "UTF-8") -> Column:
    """What is wrong with an ISO 2709 record: ``length``, ``base``, ``directory`` or ``field``; null if nothing is.

    The leader's length must be the record's, with its last mark or without it; the directory must fill the place up to the base address
    with whole entries of digits, and every field must lie in the record and end with its mark.
    """
    unit = 2 if _wide(charset) else 1
    mark = F.encode(F.lit(FIELD_MARK), charset if unit == 2 else "UTF-8")

    def judged(raw: Column, size: Column, f: Column) -> Column:
        told = F.substring(f["leader"], 1, 5).try_cast("int")
        broken = F.exists(f["entries"], lambda e: e["size"].isNull() | e["start"].isNull() | (e["size"] < 0) | (e["start"] < 0))
        end = lambda e: f["base"] + e["start"] + e["size"]
        outside = F.exists(f["entries"], lambda e: (end(e) > size) | (F.substring(raw, end(e) - unit + 1, F.lit(unit)) != mark))
        whole = (f["base"] - 25 * unit) % (12 * unit) == 0
        return (
            F.when(told.isNull() | ((told != size) & (told != size + unit)), "length").when(f["entries"].isNull() | (f["base"] > size), "base")
            .when(~whole | (F.substring(raw, f["base"] - unit + 1, F.lit(unit)) != mark) | broken, "directory").when(outside, "field")
        )

    return let(record.cast("binary"), lambda raw: F.when(raw.isNull(), "length").otherwise(_framed(raw, charset, lambda f: judged(raw, F.octet_length(raw), f))))


def to_iso2709(rec: Column, charset: str = "UTF-8") -> Column:
    """A record struct as ISO 2709 text: directory, base address and record length computed anew, in bytes of ``charset``, in which it is to be ``encoded``."""
    return let(rec, lambda r: _iso2709(r, charset))


def _iso2709(rec: Column, charset: str) -> Column:
    unit = 2 if _wide(charset) else 1
    size = F.octet_length if charset == "UTF-8" else lambda c: F.octet_length(encoded(c, charset))
    body = lambda f: F.concat(F.coalesce(f["ind1"], F.lit(" ")), F.coalesce(f["ind2"], F.lit(" ")), F.array_join(F.transform(f["subfield"], lambda s: F.concat(F.lit(SUBFIELD_MARK), s["code"], s["value"])), ""), F.lit(FIELD_MARK))
    control = F.transform(rec["controlfield"], lambda f: F.struct(f["tag"].alias("tag"), F.concat(f["value"], F.lit(FIELD_MARK)).alias("body")))
    all_fields = F.concat(control, F.transform(rec["datafield"], lambda f: F.struct(f["tag"].alias("tag"), body(f).alias("body"))))
    start = F.struct(F.lit("").alias("directory"), F.lit(0).alias("at"))
    pad = lambda n, w: F.lpad(n.cast("string"), w, "0")

    def written(fields: Column) -> Column:
        listed = F.aggregate(fields, start, lambda a, f: let(size(f["body"]), lambda n: F.struct(F.concat(a["directory"], f["tag"], pad(n, 4), pad(a["at"], 5)).alias("directory"), (a["at"] + n).alias("at"))))
        return let(F.struct(listed["directory"].alias("directory"), F.array_join(F.transform(fields, lambda f: f["body"]), "").alias("bodies")), framed)

    def framed(x: Column) -> Column:
        base = (F.lit(24) + F.length(x["directory"]) + 1) * unit
        return let(F.concat(x["directory"], F.lit(FIELD_MARK), x["bodies"], F.lit("\x1d")), lambda whole: headed(base, whole))

    def headed(base: Column, whole: Column) -> Column:
        leader = F.rpad(F.coalesce(rec["leader"], F.lit("")), 24, " ")
        scheme = F.substring(leader, 10, 1) if charset == "UTF-8" else F.lit("a" if unit == 2 else " ")
        return F.concat(pad(size(whole) + 24 * unit, 5), F.substring(leader, 6, 4), scheme, F.substring(leader, 11, 2), pad(base, 5), F.substring(leader, 18, 7), whole)

    return let(all_fields, written)


def read_marc(spark: SparkSession, path: str, charset: str = "UTF-8", other: str | None = None) -> DataFrame:
    """Rows (record, media_type, marc, damage) of ISO 2709 files; records as they are, in bytes if they aren't UTF-8.

    Files are split at record marks, in UTF-16 of two bytes each. Records with a ``damage`` are rejects; what can be read of them is in ``marc``.
    """
    plain = charset == "UTF-8" and other is None
    rows = spark.read.option("lineSep", "\x1d").option("encoding", charset if _wide(charset) else "UTF-8").text(path)
    raw = F.col("value").cast("binary")
    rows = rows.where(F.octet_length(raw) > 24)
    end = F.encode(F.lit("\x1d"), charset if _wide(charset) else "UTF-8")
    record = F.concat(F.col("value"), F.lit("\x1d")) if plain else F.concat(raw, end)
    own = rows.select(record.alias("record"), F.lit(MARC).alias("media_type"))
    return own.withColumns({"marc": parsed(F.col("record"), charset, other), "damage": damage(F.col("record"), charset)})


_XML = "leader string, controlfield array<struct<_VALUE: string, _tag: string>>, datafield array<struct<_tag: string, _ind1: string, _ind2: string, subfield: array<struct<_VALUE: string, _code: string>>>>"


def read_marcxml(spark: SparkSession, path: str) -> DataFrame:
    """Rows (record, media_type, marc) of MARCXML files; the record is the struct as JSON."""
    rows = spark.read.format("xml").option("rowTag", ROW_TAG[MARCXML]).schema(_XML).load(path)
    control = F.transform("controlfield", lambda f: F.struct(f["_tag"].alias("tag"), f["_VALUE"].alias("value")))
    data = F.transform("datafield", lambda f: F.struct(
        f["_tag"].alias("tag"), f["_ind1"].alias("ind1"), f["_ind2"].alias("ind2"),
        F.transform(f["subfield"], lambda s: F.struct(s["_code"].alias("code"), s["_VALUE"].alias("value"))).alias("subfield"),
    ))
    marc = F.struct(F.col("leader"), control.alias("controlfield"), data.alias("datafield")).cast(_STRUCT)
    return rows.select(F.to_json(marc).alias("record"), F.lit(MARCXML).alias("media_type"), marc.alias("marc"))


_XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def from_slim_xml(record: Column) -> Column:
    """The record struct of a MARCXML ``record`` element's text; namespace prefixes are left out."""
    def plain(c: Column) -> Column:
        for entity, sign in _XML_ENTITIES:
            c = F.replace(c, F.lit(entity), F.lit(sign))
        return c

    attribute = lambda c, name: plain(F.regexp_extract(c, rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1))
    elements = lambda c, name: F.regexp_extract_all(c, F.lit(rf"(?s)<(?:\w+:)?{name}\b[^>]*>.*?</(?:\w+:)?{name}\s*>"), F.lit(0))
    inner = lambda c: F.regexp_extract(c, r"(?s)^<[^>]*>(.*)</[^>]*>$", 1)
    head = lambda c: F.regexp_extract(c, "^<[^>]*>", 0)
    control = F.transform(elements(record, "controlfield"), lambda e: F.struct(attribute(head(e), "tag").alias("tag"), plain(inner(e)).alias("value")))
    subs = lambda e: F.transform(elements(inner(e), "subfield"), lambda s: F.struct(attribute(head(s), "code").alias("code"), plain(inner(s)).alias("value")))
    of_field = lambda e, h: F.struct(attribute(h, "tag").alias("tag"), attribute(h, "ind1").alias("ind1"), attribute(h, "ind2").alias("ind2"), subs(e).alias("subfield"))
    data = F.transform(elements(record, "datafield"), lambda e: let(head(e), lambda h: of_field(e, h)))
    leader = F.try_element_at(F.transform(elements(record, "leader"), lambda e: plain(inner(e))), F.lit(1))
    return F.struct(leader.alias("leader"), control.alias("controlfield"), data.alias("datafield")).cast(_STRUCT)


def to_slim_xml(rec: Column) -> Column:
    """A record struct as a MARCXML ``record`` element."""
    return let(rec, _slim_xml)


def _slim_xml(rec: Column) -> Column:
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    control = F.array_join(F.transform(rec["controlfield"], lambda f: text('<controlfield tag="', esc(f["tag"]), '">', esc(f["value"]), "</controlfield>")), "")
    sub = lambda s: text('<subfield code="', esc(s["code"]), '">', esc(s["value"]), "</subfield>")
    data = F.array_join(F.transform(rec["datafield"], lambda f: text('<datafield tag="', esc(f["tag"]), '" ind1="', esc(f["ind1"]), '" ind2="', esc(f["ind2"]), '">', F.array_join(F.transform(f["subfield"], sub), ""), "</datafield>")), "")
    return text("<record><leader>", esc(rec["leader"]), "</leader>", control, data, "</record>")


def tuples(records: DataFrame, generate_collections: bool = False, linking: bool = True) -> DataFrame:
    """Tuples of MARC records (record, media_type, marc, pos): the record, its copies, links, linking entries and collections."""
    m = F.col("marc")
    base = records.select("record", "media_type", F.col("pos").alias("input_pos"), "marc", F.lower(M.kind(m)).alias("kind"), F.lower(M.source(m)).alias("source"), F.lower(M.key(m)).alias("key"), M.dates(m)["record_start"].alias("time_source"))
    base = base.where((F.col("kind") != "") & (F.col("source") != ""))
    blank = F.lit(None).cast("string")
    entity = lambda k, s, i, rec: F.struct(k.alias("kind"), s.alias("source"), i.alias("key"), rec.alias("record"), *[blank.alias(c) for c in ("kind_from", "source_from", "key_from", "relation_kind", "kind_to", "source_to", "key_to")])

    def edge(a: tuple, relation: str, b: tuple) -> Column:
        ends = [x.alias(f"{c}_{e}") for e, node in (("from", a), ("to", b)) for c, x in zip(("kind", "source", "key"), node, strict=True)]
        return F.struct(*[blank.alias(c) for c in ("kind", "source", "key", "record")], *ends[:3], F.lit(relation).alias("relation_kind"), *ends[3:])

    own = (F.col("kind"), F.col("source"), F.col("key"))
    urls = F.transform(M.links(m), lambda x: F.struct(F.lower(F.regexp_extract(x["href"], "^(?i)https?://([^/?#]+)", 1)).alias("s"), F.lower(F.regexp_extract(x["href"], "^(?i)https?://[^/?#]+(.*)", 1)).alias("k")))
    urls = F.filter(urls, lambda u: (u["s"] != "") & (u["k"] != ""))
    item_of = F.array_distinct(M.items(m))
    parts = [
        F.when(~F.col("kind").isin("item", "url"), F.array(entity(*own, F.col("record")))).otherwise(F.expr("array()")),
        F.flatten(F.transform(item_of, lambda i: F.array(entity(F.lit("item"), F.lower(i["source"]), F.lower(i["key"]), blank), edge(own, "item", (F.lit("item"), F.lower(i["source"]), F.lower(i["key"])))))),
        F.transform(urls, lambda u: edge((F.lit("url"), u["s"], u["k"]), "relatedTo", own)),
    ]
    if generate_collections:
        parts.append(F.flatten(F.transform(M.collections(m), lambda c: F.array(entity(F.lit("collection"), F.col("source"), F.lower(c), blank), edge((F.lit("collection"), F.col("source"), F.lower(c)), "item", own)))))
    typed = [p if k else F.filter(F.array(entity(*own, F.col("record"))), lambda _: ~F.col("kind").isin("item", "url")) for k, p in enumerate(parts)]
    own = base.select("media_type", "time_source", "input_pos", F.explode(F.concat(*typed)).alias("t")).select("t.*", "media_type", "time_source", "input_pos", blank.alias("provider"))
    return own.unionByName(linking_tuples(linking_edges(records))) if linking else own
