"""Format conversion: expressions by (from, to) media type, and field maps held as data.

Where no conversion is known a record passes unchanged.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import marc as M
from ..functions.dates import parse_date
from ..functions.text import let, record_url
from ..model import MARC_RECORD
from ..sources import feeds
from ..sources import marc as marc_source
from ..sources import registry as R

# MARC 21 leader types and what they are called.
LEADER_TYPES = {
    "a": "Book", "c": "MusicComposition", "d": "MusicComposition", "e": "Map", "f": "Map", "g": "VideoObject", "i": "AudioObject", "j": "MusicRecording",
    "k": "ImageObject", "m": "SoftwareApplication", "o": "Collection", "p": "Collection", "r": "Thing", "t": "Manuscript",
}
_NAME = {"a": "a", "b": "+a", "c": "c", "d": "b", "f": "d", "g": "q", "p": "u", "3": "0", "4": "4"}
_BODY = {"a": "a", "b": "b", "d": "n", "e": "c", "f": "d", "g": "a", "p": "u", "3": "0", "4": "4"}
_TERM = {"a": "a", "x": "x", "y": "z", "z": "y", "2": "2", "3": "0"}
_TITLE = {"a": "a", "h": "n", "i": "p", "k": "f", "l": "k", "m": "l", "n": "g", "q": "s", "r": "m", "s": "n", "u": "r", "v": "g"}
_LINK = {"a": "a", "c": "d", "d": "d", "e": "b", "h": "g", "p": "h", "t": "t", "u": "o", "v": "g", "x": "x", "y": "z"}
_NOTE = {"a": "a"}
#: Fixed values, the crosswalk from RUSMARC (UNIMARC) to MARC 21 by tag: target tag, subfield codes with
#: their new ones ("+a": appended to $a), and the indicator needed where a tag has several targets.
CROSSWALK = (
    ("010", "020", {"a": "a", "b": "q", "d": "c", "z": "z"}, None),
    ("011", "022", {"a": "a", "y": "y", "z": "z"}, None),
    ("020", "015", {"a": "2", "b": "a", "z": "z"}, None),
    ("021", "017", {"a": "b", "b": "a", "z": "z"}, None),
    ("022", "086", {"a": "2", "b": "a", "z": "z"}, None),
    ("035", "035", {"a": "a", "z": "z"}, None),
    ("040", "030", {"a": "a", "z": "z"}, None),
    ("071", "028", {"a": "a", "b": "b", "c": "q"}, None),
    ("101", "041", {"a": "a", "b": "k", "c": "h", "d": "b", "e": "f", "g": "a", "h": "e", "i": "g", "j": "j"}, None),
    ("102", "044", {"a": "a", "b": "b"}, None),
    ("200", "245", {"a": "a", "b": "h", "c": "b", "d": "b", "e": "b", "f": "c", "g": "c", "h": "n", "i": "p"}, None),
    ("205", "250", {"a": "a", "b": "b", "d": "b", "f": "b"}, None),
    ("206", "255", {"a": "a", "b": "a", "c": "b", "d": "c"}, None),
    ("207", "362", {"a": "a", "z": "z"}, None),
    ("208", "254", {"a": "a", "d": "a"}, None),
    ("210", "260", {"a": "a", "c": "b", "d": "c", "e": "e", "g": "f", "h": "g"}, None),
    ("211", "263", _NOTE, None),
    ("215", "300", {"a": "a", "c": "b", "d": "c", "e": "e"}, None),
    ("225", "490", {"a": "a", "e": "a", "h": "a", "i": "a", "v": "v", "x": "x"}, None),
    ("230", "256", _NOTE, None),
    ("300", "500", _NOTE, None),
    ("316", "590", _NOTE, None),
    ("320", "504", _NOTE, None),
    ("321", "510", {"a": "a", "b": "b", "x": "x"}, None),
    ("326", "310", {"a": "a", "b": "b"}, None),
    ("327", "505", _NOTE, None),
    ("328", "502", _NOTE, None),
    ("330", "520", _NOTE, None),
    ("332", "524", _NOTE, None),
    ("333", "521", _NOTE, None),
    ("336", "500", _NOTE, None),
    ("337", "538", _NOTE, None),
    ("345", "037", {"a": "b", "b": "a", "c": "f", "d": "c"}, None),
    ("410", "760", _LINK, None),
    ("411", "762", _LINK, None),
    ("421", "770", _LINK, None),
    ("422", "772", _LINK, None),
    ("423", "777", _LINK, None),
    ("430", "780", _LINK, None),
    ("440", "785", _LINK, None),
    ("451", "775", _LINK, None),
    ("452", "776", _LINK, None),
    ("453", "767", _LINK, None),
    ("454", "765", _LINK, None),
    ("455", "787", _LINK, None),
    ("456", "787", _LINK, None),
    ("461", "490", {"t": "a", "v": "v", "x": "x"}, None),
    ("462", "774", _LINK, None),
    ("463", "773", _LINK, None),
    ("464", "774", _LINK, None),
    ("470", "787", _LINK, None),
    ("488", "787", _LINK, None),
    ("500", "130", _TITLE, ("ind2", "1")),
    ("500", "240", _TITLE, ("ind2", "0")),
    ("501", "243", _TITLE, None),
    ("520", "247", {"a": "a", "e": "b", "h": "n", "i": "p", "x": "x"}, None),
    ("530", "222", {"a": "a", "b": "b"}, None),
    ("531", "210", {"a": "a", "b": "b"}, None),
    ("532", "246", _NOTE, None),
    ("541", "242", {"a": "a", "e": "b", "f": "c", "h": "n", "i": "p", "z": "y"}, None),
    ("545", "773", {"a": "t"}, None),
    ("600", "600", {**_NAME, "x": "x", "y": "z", "z": "y", "2": "2"}, None),
    ("601", "610", {**_BODY, "x": "x", "y": "z", "z": "y", "2": "2"}, None),
    ("603", "600", {"a": "a", "f": "d", "x": "x", "y": "z", "z": "y"}, None),
    ("605", "630", {**_TITLE, "x": "x", "y": "z", "z": "y"}, None),
    ("606", "650", _TERM, None),
    ("607", "651", _TERM, None),
    ("610", "653", _NOTE, None),
    ("615", "072", {"a": "x", "n": "a", "2": "2"}, None),
    ("620", "752", {"a": "a", "b": "b", "c": "c", "d": "d"}, None),
    ("626", "753", {"a": "a", "b": "b", "c": "c"}, None),
    ("660", "043", _NOTE, None),
    ("661", "045", _NOTE, None),
    ("670", "979", _NOTE, None),
    ("675", "080", {"a": "a", "v": "2"}, None),
    ("676", "082", {"a": "a", "v": "2"}, None),
    ("680", "050", {"a": "a", "b": "b"}, None),
    ("686", "084", {"a": "a", "2": "2"}, None),
    ("700", "100", _NAME, None),
    ("701", "700", _NAME, None),
    ("702", "700", _NAME, None),
    ("710", "110", _BODY, ("ind1", "0")),
    ("710", "111", _BODY, ("ind1", "1")),
    ("711", "710", _BODY, ("ind1", "0")),
    ("711", "711", _BODY, ("ind1", "1")),
    ("712", "710", _BODY, None),
    ("720", "100", {"a": "a", "f": "d", "4": "4"}, None),
    ("721", "700", {"a": "a", "f": "d", "4": "4"}, None),
    ("801", "040", {"b": "a", "g": "e"}, None),
    ("852", "852", {c: c for c in "abchijkptxz"}, None),
    ("856", "856", {c: c for c in "adfhoqsuxyz23"}, None),
    ("886", "979", _NOTE, None),
    ("900", "590", _NOTE, None),
)


def _joined(xs: Column, sep: str = " ") -> Column:
    return F.when(F.size(xs) > 0, F.array_join(xs, sep))


def _crosswalk() -> Column:
    """The crosswalk as one value of the plan: each tag's targets, with the indicator needed and the codes."""
    rules: dict[str, list] = {}
    for tag, target, codes, needed in CROSSWALK:
        rules.setdefault(tag, []).append({"target": target, "needed": "".join(needed or ()), "codes": codes})
    return F.from_json(F.lit(json.dumps(rules)), "map<string, array<struct<target: string, needed: string, codes: map<string, string>>>>")


def _recoded(f: Column, rule: Column) -> Column:
    """A field under a rule's tag with its subfields' codes changed; subfields without a new code go.

    Subfields that belong to $a of the target follow it after a comma.
    """
    moved = F.transform(f["subfield"], lambda s: F.struct(F.try_element_at(rule["codes"], s["code"]).alias("code"), s["value"].alias("value")))

    def whole(kept: Column) -> Column:
        more = F.transform(F.filter(kept, lambda s: s["code"] == "+a"), lambda s: s["value"])
        joined = lambda s: F.struct(s["code"].alias("code"), F.when(s["code"] == "a", F.array_join(F.concat(F.array(s["value"]), more), ", ")).otherwise(s["value"]).alias("value"))
        return F.transform(F.filter(kept, lambda s: s["code"] != "+a"), joined)

    subfield = let(F.filter(moved, lambda s: s["code"].isNotNull() & s["value"].isNotNull()), whole)
    return F.struct(rule["target"].alias("tag"), f["ind1"].alias("ind1"), f["ind2"].alias("ind2"), subfield.alias("subfield"))


def _retagged(fields: Column, rules: Column) -> Column:
    """All fields of a record under their new tags, in order."""
    def of_field(f: Column) -> Column:
        fits = lambda r: (r["needed"] == "") | (r["needed"] == F.concat(F.lit("ind1"), f["ind1"])) | (r["needed"] == F.concat(F.lit("ind2"), f["ind2"]))
        return F.transform(F.filter(F.coalesce(F.try_element_at(rules, f["tag"]), F.array().cast("array<struct<target: string, needed: string, codes: map<string, string>>>")), fits), lambda r: _recoded(f, r))

    return F.array_sort(F.filter(F.flatten(F.transform(fields, of_field)), lambda f: F.size(f["subfield"]) > 0))


def rusmarc_to_marc21(rec: Column) -> Column:
    """A RUSMARC record under MARC 21 tags and subfield codes, 008 rebuilt from 100$a."""
    return let(F.rpad(F.coalesce(M.first(rec, "100", "a"), F.lit("")), 36, " "), lambda coded: _of_rusmarc(rec, coded))


def _of_rusmarc(rec: Column, coded: Column) -> Column:
    at = lambda k, n: F.substring(coded, k + 1, n)
    kinds = F.create_map(*[F.lit(x) for p in M.RUSMARC_TYPES.items() for x in p])
    of_date = F.coalesce(F.try_element_at(kinds, at(8, 1)), F.lit(" "))
    language = F.rpad(F.coalesce(M.first(rec, "101", "a"), F.lit("   ")), 3, " ")
    blank = lambda n: F.lit(" " * n)
    f008 = F.concat(at(2, 6), of_date, at(9, 8), at(22, 2), blank(5), at(18, 1), blank(10), at(33, 1), blank(1), language, blank(2))
    keep = F.filter(rec["controlfield"], lambda f: f["tag"].isin("001", "005", "007"))
    issuer = M.first(rec, "801", "b")
    extra = [F.struct(F.lit("008").alias("tag"), f008.alias("value"))]
    control = F.concat(keep, F.when(issuer.isNotNull(), F.array(F.struct(F.lit("003").alias("tag"), issuer.alias("value")))).otherwise(F.array().cast("array<struct<tag:string,value:string>>")), F.array(*extra))
    moved = let(_crosswalk(), lambda rules: _retagged(rec["datafield"], rules))
    return F.struct(rec["leader"].alias("leader"), control.alias("controlfield"), moved.alias("datafield"))


def _agent(f: Column) -> Column:
    life = F.split(F.coalesce(F.try_element_at(M.codes(f, "d"), F.lit(1)), F.lit("")), "-")
    year = lambda k: F.when(F.trim(F.get(life, F.lit(k))) != "", F.trim(F.get(life, F.lit(k))))
    return F.struct(_joined(M.codes(f, "a", "b", "c")).alias("name"), year(0).alias("birthDate"), year(1).alias("deathDate"), F.try_element_at(M.codes(f, "4"), F.lit(1)).alias("role"), F.try_element_at(M.codes(f, "e", "g"), F.lit(1)).alias("roleName"))


def _topics(rec: Column, tags: tuple[str, ...]) -> Column:
    return F.array_distinct(F.filter(F.transform(M.fields(rec, *tags), lambda f: F.array_join(M.codes(f, "a", "x", "y", "z"), " -- ")), lambda s: s != ""))


def marc21_to_opds(rec: Column, base: str = "") -> Column:
    """A MARC 21 record as a publication: struct of metadata and links."""
    return let(rec, lambda r: let(M.dates(r), lambda dates: _opds_of_marc21(r, dates, base)))


def _opds_of_marc21(rec: Column, dates: Column, base: str) -> Column:
    title = F.coalesce(M.first(rec, "245", "a"), M.first(rec, "130", "a"), _joined(M.values(rec, "773", "t")), M.first(rec, "490", "a"))
    title = F.trim(F.get(F.split(title, " +[:/] *"), F.lit(0)))
    types = F.create_map(*[F.lit(x) for p in LEADER_TYPES.items() for x in p])
    f008 = M.control(rec, "008")
    issuer = F.coalesce(M.control(rec, "003"), M.first(rec, "040", "a"), F.lit("unknown"))
    ident = F.element_at(F.split(F.coalesce(M.control(rec, "001"), F.lit("")), "/"), -1)
    spoken = F.array_distinct(F.filter(F.concat(F.array(F.substring(f008, 36, 3)), M.values(rec, "041", "a", "b", "d", "e", "f", "g", "h")), lambda x: F.rlike(x, F.lit("^[a-z]{3}$"))))
    pages = F.array_max(F.transform(F.regexp_extract_all(F.coalesce(M.first(rec, "300", "a"), F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int")))
    url = record_url(base, F.lit("instance"), issuer, ident)
    meta = F.struct(
        F.coalesce(F.try_element_at(types, M.leader_at(rec, M.TYPE)), F.lit("Thing")).alias("type"), title.alias("title"), F.coalesce(M.first(rec, "245", "b"), M.first(rec, "773", "b")).alias("subtitle"),
        M.first(rec, "210", "a").alias("sortAs"), F.array_distinct(M.values(rec, "246", "a")).alias("alternateName"), url.alias("identifier"), dates["record_updated"].alias("modified"),
        spoken.alias("language"), pages.alias("numberOfPages"), F.transform(M.fields(rec, "100", "110"), _agent).alias("author"), F.transform(M.fields(rec, "700", "710", "720"), _agent).alias("contributor"),
        F.coalesce(M.first(rec, "260", "b"), M.first(rec, "260", "a")).alias("publisher"), F.coalesce(dates["published"], dates["date_start"]).alias("published"),
        F.struct(
            _topics(rec, ("656",)).alias("occupation"), F.array_distinct(M.values(rec, "520", "a")).alias("summary"), _topics(rec, ("600", "610", "611")).alias("agent"), _topics(rec, ("630",)).alias("work"),
            _topics(rec, ("648",)).alias("temporal"), _topics(rec, ("651", "662")).alias("place"), _topics(rec, ("655",)).alias("genreForm"), _topics(rec, ("650", "653")).alias("topic"),
        ).alias("subject"),
        _joined(M.values(rec, "505", "a"), "\n").alias("toc"), _joined(M.values(rec, "510", "a"), "; ").alias("citation"), _joined(F.concat(*[M.values(rec, t, "a") for t in ("500", "520", "546", "533", "555")]), "\n").alias("description"),
        F.struct(F.array_distinct(F.concat(M.values(rec, "490", "a"), M.values(rec, "440", "a"))).alias("series"), F.array_distinct(F.concat(M.values(rec, "852", "a"), M.values(rec, "017", "b"))).alias("collection")).alias("belongsTo"),
    )
    rel = lambda x: F.when(F.startswith(F.coalesce(x["type"], F.lit("")), F.lit("image/")), "preview").when(x["ind2"] == "0", "http://opds-spec.org/acquisition").when(x["ind2"] == "2", "related").otherwise("alternate")
    links = F.transform(M.links(rec), lambda x: F.struct(x["href"].alias("href"), x["type"].alias("type"), F.when(x["title"] != "", x["title"]).alias("title"), rel(x).alias("rel")))
    return F.struct(meta.alias("metadata"), links.alias("links"))


def marc21_to_bibframe(rec: Column) -> Column:
    """A MARC 21 record as a BIBFRAME work with its instance."""
    name = lambda f: _joined(M.codes(f, "a", "b", "c"))
    agent = lambda primary: lambda f: F.struct(name(f).alias("agent"), F.lit(primary).alias("primary"), F.try_element_at(M.codes(f, "4"), F.lit(1)).alias("role"))
    return F.struct(
        F.struct(M.control(rec, "001").alias("identifiedBy"), M.control(rec, "003").alias("source"), M.first(rec, "040", "a").alias("assigner")).alias("adminMetadata"),
        F.array_distinct(F.concat(*[M.values(rec, t, "a") for t in ("130", "210", "245", "246", "490")])).alias("title"),
        F.concat(F.transform(M.fields(rec, "100"), agent(True)), F.transform(M.fields(rec, "700", "720"), agent(False))).alias("contribution"),
        F.array_distinct(F.concat(M.values(rec, "041", "a"), F.array_compact(F.array(F.substring(M.control(rec, "008"), 36, 3))))).alias("language"),
        F.concat(M.values(rec, "546", "a"), M.values(rec, "130", "l")).alias("note"), M.values(rec, "510", "a").alias("citationWithinSource"), _topics(rec, ("650", "651", "653")).alias("subject"),
        F.struct(
            F.struct(M.values(rec, "260", "a").alias("place"), M.values(rec, "260", "b").alias("agent"), M.values(rec, "260", "c").alias("date")).alias("provisionActivity"), M.values(rec, "505", "a").alias("tableOfContents"),
            F.concat(M.values(rec, "245", "c"), M.values(rec, "505", "r")).alias("responsibilityStatement"), M.values(rec, "250", "a").alias("editionStatement"), M.values(rec, "773", "t").alias("partOf"),
            M.values(rec, "490", "a").alias("hasSeries"), M.values(rec, "300", "c").alias("dimensions"), M.values(rec, "300", "a").alias("extent"), M.values(rec, "561", "a").alias("custodialHistory"),
        ).alias("hasInstance"),
    )


def either_marc(rec: Column) -> Column:
    """A record in MARC 21, retagged if it is RUSMARC."""
    return let(rec, lambda r: F.when(M.schema(r) == "rusmarc", rusmarc_to_marc21(r)).otherwise(r))


def _of_marc(render: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda record: let(marc_source.parsed(record), lambda m: let(either_marc(m), render))


def quads_to_opds(record: Column) -> Column:
    """Statements of a subject as a publication."""
    from ..sources.quads import labels, quad

    statements = F.filter(F.transform(F.split(record, "\n"), quad), lambda q: q.isNotNull())
    return F.to_json(F.struct(F.struct(F.get(statements, F.lit(0))["subject"].alias("identifier"), labels(statements, "prefLabel").alias("title"), labels(statements, "note").alias("description")).alias("metadata")))


def _of_json(schema: str, render: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda record: let(F.from_json(record, schema), render)


def _of_marcxml(render: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Of MARCXML records as ``read_marcxml`` holds them, JSON of the struct, or as an element's text."""
    def read(record: Column) -> Column:
        return F.when(F.startswith(F.ltrim(record), F.lit("<")), marc_source.from_slim_xml(record)).otherwise(F.from_json(record, MARC_RECORD.simpleString()))

    return lambda record: let(read(record), lambda m: let(either_marc(m), render))


def tsv_to_opds(record: Column) -> Column:
    """A header and a line as a publication: ``record.…`` columns as its metadata, kind, source and key as its identifier."""
    lines = F.split(record, "\n")

    def render(rows: Column) -> Column:
        pairs = F.arrays_zip(F.transform(rows["names"], lambda n: F.trim(n)).alias("k"), rows["cells"].alias("v"))
        named = lambda *names: F.try_element_at(F.transform(F.filter(pairs, lambda p: p["k"].isin(*names) & (F.trim(p["v"]) != "")), lambda p: p["v"]), F.lit(1))
        extra = F.map_from_entries(F.transform(F.filter(pairs, lambda p: F.startswith(p["k"], F.lit("record.")) & (F.trim(p["v"]) != "") & (p["k"] != "record.title")), lambda p: F.struct(F.substr(p["k"], F.lit(8)), p["v"])))
        ident = F.concat_ws("/", named("kind"), named("source"), named("key"))
        return F.to_json(F.struct(F.struct(named("@type").alias("type"), named("record.title", "title").alias("title"), F.when(ident != "", ident).alias("identifier"), extra.alias("about")).alias("metadata")))

    return let(F.struct(F.split(F.get(lines, F.lit(0)), "\t").alias("names"), F.split(F.get(lines, F.lit(1)), "\t").alias("cells")), render)


def atom_to_opds(e: Column) -> Column:
    """An Atom entry as a publication."""
    people = F.transform(e["author"], lambda a: F.struct(a["name"].alias("name")))
    links = F.transform(e["link"], lambda x: F.struct(x["_href"].alias("href"), x["_type"].alias("type"), x["_title"].alias("title"), x["_rel"].alias("rel")))
    topics = F.transform(e["category"], lambda c: F.coalesce(c["_label"], c["_term"]))
    meta = F.struct(e["title"].alias("title"), e["id"].alias("identifier"), e["updated"].alias("modified"), e["published"].alias("published"), e["summary"].alias("description"), people.alias("author"), topics.alias("subject"))
    return F.struct(meta.alias("metadata"), links.alias("links"))


ONIX_SCHEMA = (
    "RecordReference string, ProductIdentifier array<struct<ProductIDType: string, IDValue: string>>, DescriptiveDetail struct<"
    "TitleDetail: struct<TitleElement: struct<TitleText: string, Subtitle: string>>, Contributor: array<struct<PersonName: string, ContributorRole: string>>, "
    "Language: array<struct<LanguageCode: string>>, Extent: array<struct<ExtentType: string, ExtentValue: string>>, Subject: array<struct<SubjectHeadingText: string>>>, "
    "CollateralDetail struct<TextContent: array<struct<TextType: string, Text: string>>>, PublishingDetail struct<Publisher: struct<PublisherName: string>, PublishingDate: array<struct<Date: string>>>"
)


def onix_to_opds(p: Column) -> Column:
    """An ONIX product as a publication."""
    d = p["DescriptiveDetail"]
    numbers = F.transform(p["ProductIdentifier"], lambda x: F.concat_ws(":", F.try_element_at(F.create_map(F.lit("15"), F.lit("isbn"), F.lit("02"), F.lit("isbn"), F.lit("06"), F.lit("doi")), x["ProductIDType"]), x["IDValue"]))
    pages = F.transform(F.filter(d["Extent"], lambda x: x["ExtentType"].isin("00", "07", "10", "11")), lambda x: x["ExtentValue"].try_cast("int"))
    meta = F.struct(
        d["TitleDetail"]["TitleElement"]["TitleText"].alias("title"), d["TitleDetail"]["TitleElement"]["Subtitle"].alias("subtitle"),
        F.coalesce(F.try_element_at(numbers, F.lit(1)), p["RecordReference"]).alias("identifier"), numbers.alias("alternateIdentifier"),
        F.transform(F.filter(d["Contributor"], lambda c: F.startswith(c["ContributorRole"], F.lit("A"))), lambda c: F.struct(c["PersonName"].alias("name"))).alias("author"),
        F.transform(F.filter(d["Contributor"], lambda c: ~F.startswith(c["ContributorRole"], F.lit("A"))), lambda c: F.struct(c["PersonName"].alias("name"), c["ContributorRole"].alias("role"))).alias("contributor"),
        F.transform(d["Language"], lambda x: x["LanguageCode"]).alias("language"), F.try_element_at(pages, F.lit(1)).alias("numberOfPages"), F.transform(d["Subject"], lambda x: x["SubjectHeadingText"]).alias("subject"),
        F.try_element_at(F.transform(p["CollateralDetail"]["TextContent"], lambda t: t["Text"]), F.lit(1)).alias("description"),
        p["PublishingDetail"]["Publisher"]["PublisherName"].alias("publisher"), parse_date(F.try_element_at(p["PublishingDetail"]["PublishingDate"], F.lit(1))["Date"]).alias("published"),
    )
    return F.struct(meta.alias("metadata"))


REGISTRY_SCHEMA = (
    "item struct<id: string, num: string>, part struct<id: string, name: string>, instance struct<id: string, title: string, author: string, year: string>, "
    "organization struct<id: string, name: string>, group struct<id: string, name: string>"
)


def registry_to_opds(r: Column) -> Column:
    """A joined record of a registry dump (a copy with its part, item, organisation and group) as a publication."""
    i = r["instance"]
    title = F.concat_ws(". ", i["title"], r["part"]["name"])
    meta = F.struct(
        title.alias("title"), r["item"]["id"].alias("identifier"), F.when(i["author"].isNotNull(), F.array(F.struct(i["author"].alias("name")))).alias("author"),
        parse_date(i["year"], True).alias("published"), r["item"]["num"].alias("position"),
        F.struct(F.array_compact(F.array(r["group"]["name"])).alias("series"), F.array_compact(F.array(r["organization"]["name"])).alias("collection")).alias("belongsTo"),
    )
    return F.struct(meta.alias("metadata"))


CONVERTERS: dict[tuple[str, str], Callable[[Column], Column]] = {
    (R.MARC, R.OPDS): _of_marc(lambda m: F.to_json(marc21_to_opds(m))),
    (R.MARC, R.MARCXML): _of_marc(marc_source.to_slim_xml),
    (R.MARC, R.LD_JSON): _of_marc(lambda m: F.to_json(marc21_to_bibframe(m))),
    (R.MARC, R.JSON): lambda record: F.to_json(marc_source.parsed(record)),
    (R.MARC, R.MARC): _of_marc(marc_source.to_iso2709),
    (R.MARCXML, R.OPDS): _of_marcxml(lambda m: F.to_json(marc21_to_opds(m))),
    (R.MARCXML, R.MARC): _of_marcxml(marc_source.to_iso2709),
    (R.MARCXML, R.LD_JSON): _of_marcxml(lambda m: F.to_json(marc21_to_bibframe(m))),
    (R.MARCXML, R.MARCXML): _of_marcxml(marc_source.to_slim_xml),
    (R.MARCXML, R.JSON): _of_marcxml(F.to_json),
    (R.QUADS, R.OPDS): quads_to_opds,
    (R.TSV, R.OPDS): tsv_to_opds,
    (R.ATOM, R.OPDS): _of_json(feeds.ATOM_SCHEMA, lambda e: F.to_json(atom_to_opds(e))),
    (R.LITRES, R.OPDS): _of_json(feeds.BOOK_SCHEMA, lambda b: F.to_json(F.struct(feeds.book_publication(b).alias("metadata")))),
    (R.ONIX, R.OPDS): _of_json(ONIX_SCHEMA, lambda p: F.to_json(onix_to_opds(p))),
    (R.REGISTRY, R.OPDS): _of_json(REGISTRY_SCHEMA, lambda r: F.to_json(registry_to_opds(r))),
    (R.OPDS, R.OPDS): lambda record: record,
    (R.JSON, R.JSON): lambda record: record,
}


def targets(media_type: str) -> list[str]:
    """Media types that a record of one can be converted to."""
    return sorted(to for source, to in CONVERTERS if source == media_type)


def converted(records: DataFrame, target: str, record: str = "record", media_type: str = "media_type", sources: tuple[str, ...] | None = None) -> DataFrame:
    """``records`` with ``converted``: in ``target`` where a conversion is known, else as they are.

    ``sources`` names the media types that are to be converted, all if it isn't given; fewer make a smaller plan.
    """
    out = F.col(record)
    for (source, to), render in CONVERTERS.items():
        if to == target and (sources is None or source in sources):
            out = F.when(F.col(media_type) == source, render(F.col(record))).otherwise(out)
    return records.withColumn("converted", out)
