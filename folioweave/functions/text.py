"""Strings, keys and identifiers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that count as empty in records.
EMPTY = frozenset({"", "0000-00-00"})
_SECRET = re.compile(r"(?i)(^|[^a-z])secret([^a-z]|$)")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that stands in the plan once, however often ``then`` uses it.

    A column used several times is copied into the plan each time; where such columns build on each
    other the plan grows by the product.
    """
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def sanitize_kind(kind: Column) -> Column:
    """Last part behind '#' or ':', in snake case, of a-z, 0-9 and '_' only; null if nothing is left."""
    last = F.try_element_at(F.filter(F.split(kind, "[#:]"), lambda p: p != ""), F.lit(-1))
    snake = F.regexp_replace(last, r"([a-z0-9])([A-Z])", "$1_$2")
    snake = F.regexp_replace(snake, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return _blank_to_null(F.trim(F.regexp_replace(F.lower(snake), "[^a-z0-9]+", "_"), F.lit("_")))


def percent_encoded(c: Column) -> Column:
    """RFC 3986 percent-encoding of a path segment."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def sanitize_key(key: Column) -> Column:
    """``/kind/source/rest…`` as ``/resources/kind/source/rest``, lower-cased and encoded; other keys as they are."""
    named = F.filter(F.split(key, "/"), lambda p: p != "")
    plain = F.transform(named, lambda p: F.lower(F.coalesce(F.try_url_decode(F.trim(p)), F.trim(p))))

    def path(parts: Column) -> Column:
        own = F.when(F.get(parts, F.lit(0)) == "resources", F.slice(parts, 2, F.size(parts))).otherwise(parts)
        rest = F.array_join(F.slice(own, 3, F.size(own) + 1), "/")
        steps = F.concat(F.array(F.coalesce(F.get(own, F.lit(0)), F.lit("")), F.coalesce(F.get(own, F.lit(1)), F.lit(""))), F.array(rest))
        return F.concat(F.lit("/resources/"), F.array_join(F.transform(steps, percent_encoded), "/"))

    return F.when(F.startswith(key, F.lit("/")), let(plain, path)).otherwise(key)


def tokenized(text: Column) -> Column:
    """Words and the signs of punctuation, each a token, joined by blanks; tags are left out."""
    shown = F.regexp_replace(text, r"(?i)</?[a-z][^>]*>", "")
    return F.array_join(F.regexp_extract_all(shown, F.lit(r"[\p{L}\p{N}]+|[-_.!?,\"';]"), F.lit(0)), " ")


def length_in_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def escaped_unprintable(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))


def content_hash(record: Column) -> Column:
    """32 hexadecimal digits that stand for a record's content."""
    return F.md5(record)


def uuid_text(hash32: Column) -> Column:
    """32 hexadecimal digits in the 8-4-4-4-12 form."""
    return F.concat_ws("-", *[F.substring(hash32, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def bare_uuid(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))


# Fixed value: the signs of base 58, in order.
BASE58 = "123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"


def base58(raw: Column) -> Column:
    """Bytes, the first one the highest, as a number in base 58; '' for zero and for no bytes.

    Digits are kept lowest first; each byte multiplies them by 256 and is carried through them.
    """
    digits = F.array().cast("array<int>")

    def carried(a: Column, byte: Column) -> Column:
        start = F.struct(byte.alias("carry"), digits.alias("out"))
        step = lambda s, d: let(d * 256 + s["carry"], lambda v: F.struct(F.floor(v / 58).cast("int").alias("carry"), F.array_append(s["out"], v % 58).alias("out")))
        # What is carried out of the last digit is under 256: two digits more at most.
        return let(F.aggregate(a, start, step), lambda s: F.concat(s["out"], F.filter(F.array(s["carry"] % 58, F.floor(s["carry"] / 58).cast("int")), lambda d, i: (i == 0) & (s["carry"] > 0) | (i == 1) & (s["carry"] >= 58))))

    octet = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
    octets = F.when(F.octet_length(raw) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1))), octet)).otherwise(digits)
    found = F.reverse(F.aggregate(octets, digits, carried))
    return F.when(raw.isNotNull(), F.array_join(F.transform(found, lambda d: F.substring(F.lit(BASE58), d + 1, F.lit(1))), ""))


def base58_number(n: Column) -> Column:
    """A number of zero or more in base 58; null for others. A long has eleven digits at most, each a quotient's remainder."""
    whole = n.cast("long")
    digit = lambda p: F.substring(F.lit(BASE58), (F.call_function("div", whole, F.lit(p).cast("long")) % 58).cast("int") + 1, F.lit(1))
    digits = [F.when(whole >= F.lit(58**k).cast("long"), digit(58**k)).otherwise("") for k in range(10, -1, -1)]
    return F.when(n >= 0, F.concat(*digits))


def pretty_bytes(n: Column) -> Column:
    """Bytes with a decimal unit and one digit behind the point."""
    units = ["B", "kB", "MB", "GB", "TB", "PB"]
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(n >= F.lit(1000**k), F.concat(F.call_function("format_number", n / 1000**k, F.lit("0.0")), F.lit(f" {unit}"))).otherwise(out)
    return out


def parse_identifier(text: Column, source: Column | None = None) -> Column:
    """Struct (source, key) of ``(SRC)key``, ``scheme://src/key`` or ``src/key``; null for others.

    A given ``source`` stands in for a bracketed one. Further bracketed sources in front of the key go,
    '#' in a source or key stands for a blank.
    """
    def read(s: Column) -> Column:
        close = F.instr(s, ")")
        bracketed = F.startswith(s, F.lit("(")) & (close > 2) & (close < F.length(s))
        inside, behind = F.substr(s, F.lit(2), close - 2), F.substr(s, close + 1)
        blanks = lambda c: F.trim(F.translate(c, "#", " "))
        bare = lambda c: F.trim(F.regexp_replace(c, r"^(?:\([^)]*\)\s+)+", ""))
        if source is None:
            of_source = F.struct(blanks(inside).alias("source"), bare(blanks(behind)).alias("key"))
        else:
            given = _blank_to_null(F.trim(source))
            of_source = F.struct(F.coalesce(given, blanks(inside)).alias("source"), bare(F.when(given.isNotNull(), behind).otherwise(blanks(behind))).alias("key"))
        steps = F.filter(F.split(F.regexp_replace(s, "(?i)^[a-z0-9_-]*://", ""), "/+"), lambda p: p != "")
        of_path = F.struct(F.get(steps, F.lit(0)).alias("source"), F.array_join(F.slice(steps, 2, F.size(steps) + 1), "/").alias("key"))
        return F.when(bracketed, of_source).when(F.size(steps) > 1, of_path)

    return let(F.trim(text), read)


def host_and_path(url: Column) -> Column:
    """Struct (source, key): a URL's host and its path with the leading slash."""
    return F.struct(F.regexp_extract(url, "^https?://([^/?#]+)", 1).alias("source"), F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1).alias("key"))


def uri_to_node(uri: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Struct (kind, source, key) of a subject URI; ``prefixes`` shorten namespaces first.

    ``http://host/a/b`` is (host, a/b), ``ns:x:y`` is (ns, x:y), others have no source.
    """
    short = F.coalesce(F.try_url_decode(uri), uri)
    for url in sorted(prefixes or {}):
        short = F.replace(short, F.lit(url), F.lit(f"{prefixes[url]}:"))

    def node(s: Column) -> Column:
        part = lambda rx, k: F.lower(F.regexp_extract(s, rx, k))
        web, named = r"(?is)^https?://([^/]*)/?(.*)$", r"(?s)^([^:]*):(.*)$"
        of = lambda rx: F.struct(part(rx, 1).alias("source"), part(rx, 2).alias("key"))
        place = F.when(F.rlike(s, F.lit("^https?://")), of(web)).when(F.contains(s, F.lit(":")), of(named)).otherwise(F.struct(F.lit(None).cast("string").alias("source"), s.alias("key")))
        kind = F.when(F.contains(s, F.lit("udc-schema")), "concept_scheme").otherwise("concept")
        return F.struct(kind.alias("kind"), place["source"].alias("source"), place["key"].alias("key"))

    return let(short, node)


def record_url(base: str, kind: Column, source: Column, key: Column) -> Column:
    """``base/resources/kind/source/key``, or the key itself if it is a URL."""
    path = F.concat_ws("/", F.lit(base.rstrip("/")), F.lit("resources"), *[percent_encoded(c) for c in (kind, source, key)])
    return F.when(F.rlike(key, F.lit("(?i)^[a-z][a-z0-9+.-]*://")), key).otherwise(path)


def joined_uri(*parts: Column) -> Column:
    """URI parts joined by one slash each."""
    first, *rest = parts
    return F.concat_ws("/", F.regexp_replace(first, "/+$", ""), *[F.regexp_replace(p, "^/+|/+$", "") for p in rest])


# Patterns of a link's relation and its place, the first that fits; no relation comes first, conversions last.
LINK_ORDER = (("^$", 0), ("^self$", 1), ("(?i)/acquisition/open-access", 2), ("(?i)/acquisition", 3), ("(?i)convertedfrom", 9), ("(?i)first", 4))


def link_rank(rel: Column) -> Column:
    """A link's place by its relation; smaller comes first."""
    rank = F.lit(5)
    for pattern, place in reversed(LINK_ORDER):
        rank = F.when(F.rlike(F.coalesce(rel, F.lit("")), F.lit(pattern)), place).otherwise(rank)
    return rank


def sorted_links(links: Column) -> Column:
    """An array of links (rel, href, title) by rank, href and title."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    placed = F.transform(links, lambda x: F.struct(link_rank(x["rel"]).alias("rank"), blank(x["href"]).alias("href"), blank(x["title"]).alias("title"), x.alias("link")))
    return F.transform(F.array_sort(placed), lambda x: x["link"])


def encode_cursor(*parts: Column) -> Column:
    """``kind-serial`` or ``kind_from-kind_to-serial``."""
    return F.concat_ws("-", *[sanitize_kind(p) for p in parts[:-1]], parts[-1].cast("string"))


def decode_cursor(cursor: Column) -> Column:
    """Struct (kinds, serial); null unless the cursor has two or three parts."""
    p = F.split(cursor, "-")
    kinds = F.transform(F.slice(p, 1, F.size(p) - 1), sanitize_kind)
    return F.when(F.size(p).isin(2, 3), F.struct(kinds.alias("kinds"), F.expr("0").cast("long").alias("serial")).withField("serial", F.element_at(p, -1).try_cast("long")))


def camel_case(text: Column) -> Column:
    """``some_name`` and ``Some name`` as ``someName``."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    raised = F.transform(words, lambda w, i: F.when(i == 0, F.concat(F.lower(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))))
    return F.array_join(raised, "")


def plural(text: Column) -> Column:
    """The usual English plural of a kind's name."""
    return (
        F.when(F.rlike(text, F.lit("(?i)[^aeiou]y$")), F.regexp_replace(text, "(?i)y$", "ies"))
        .when(F.rlike(text, F.lit("(?i)(s|x|z|ch|sh)$")), F.concat(text, F.lit("es"))).otherwise(F.concat(text, F.lit("s")))
    )


def sanitized_links(links: Column) -> Column:
    """Links (rel, href, title) with an address that a reader may follow, once each, in order.

    Blanks around addresses go; addresses without a scheme of the web, mail or a name, or a path, go too.
    """
    trimmed = F.transform(links, lambda x: F.struct(x["rel"].alias("rel"), F.trim(x["href"]).alias("href"), x["title"].alias("title")))
    return sorted_links(F.array_distinct(F.filter(trimmed, lambda x: F.coalesce(F.rlike(x["href"], F.lit("(?i)^(?:https?:|mailto:|urn:|/)")), F.lit(False)))))


def _cleaned(value: object) -> object:
    """A JSON value without empty members at any depth; JSON held in strings is read."""
    if isinstance(value, str):
        if value[:1] in "[{" and value[-1:] in "]}" and value:
            try:
                return _cleaned(json.loads(value))
            except ValueError:
                return value
        return None if value.strip() in EMPTY else value
    if isinstance(value, dict):
        kept = {k: _cleaned(v) for k, v in value.items() if not _SECRET.search(k)}
        return {k: v for k, v in kept.items() if v is not None} or None
    if isinstance(value, list):
        return [v for v in map(_cleaned, value) if v is not None] or None
    return value


def clean_json(text: Column) -> Column:
    """JSON text without nulls, blank strings, void dates, empty lists and objects and secret members, at any depth.

    Null if nothing is left. Text that isn't JSON, or nests deeper than Python reads, stays as it is.
    """
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                got = None if t is None else _cleaned(json.loads(t))
            except (ValueError, RecursionError):
                return t
            return None if got is None else json.dumps(got, ensure_ascii=False, separators=(",", ":"))

        return column.map(one, na_action="ignore")

    return run(text)


def localized(names: Column, language: Column) -> Column:
    """A name of several languages (a map) in the one asked for, else in English, else the first there is."""
    found = F.coalesce(F.try_element_at(names, language), F.try_element_at(names, F.lit("en")))
    return F.coalesce(found, F.try_element_at(F.map_values(names), F.lit(1)))


def without_secrets(params: Column) -> Column:
    """A map without null values and without keys that have the word "secret" in them."""
    return F.map_filter(params, lambda k, v: v.isNotNull() & ~k.rlike(r"(?i)(^|[^a-z])secret([^a-z]|$)"))
