"""Accessors over MARC records held as a struct (leader, controlfield[], datafield[])."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import RUSMARC_TYPES, coded_dates, parse_date
from .text import let

# Fixed values of the formats: positions of the leader, codes of levels and record types.
STATUS, TYPE, LEVEL = 6, 7, 8
AUTHORITY_TYPES, HOLDINGS_TYPES, COMMUNITY_TYPES, CLASSIFICATION_TYPES = ("z",), ("u", "v", "x", "y"), ("q",), ("w",)
BIBLIOGRAPHIC_TYPES = tuple("abcdefghijklmnoprt")
COLLECTION_LEVELS = ("c", "d")
# Fixed values of the format: what a source's code may be made of, and where it stands in a record, the first place that has one.
SOURCE_CODE = r"^[\p{L}\p{N}/\-\\.@_ ]+$"
SOURCE_PLACES = ("040$a", "017$b", "003", "801$b", "035$a", "852$a")
# Other spellings of libraries' codes, in any case of letters, and as they stand in records.
SOURCE_CODES = {
    "dlib.rsl.ru": "RuMoRGB", "elar": "RuMoRGB", "rumoelar": "RuMoRGB", "rumorgb": "RuMoRGB",
    "07nlr": "RuSpRNB", "ргб": "RuSpRNB", "рнб": "RuSpRNB", "nlr": "RuSpRNB",
    "ркп": "RuMoRKP",
}
SOURCE_FIXES = {"РГБ": "RuMoRGB", "RkpciviluMoRGB": "RuMoRGB", "РНБ": "RuSpRNB"}


def control(rec: Column, tag: str) -> Column:
    """The first value of a control field."""
    return F.try_element_at(F.transform(F.filter(rec["controlfield"], lambda f: f["tag"] == tag), lambda f: f["value"]), F.lit(1))


def fields(rec: Column, *tags: str) -> Column:
    """Data fields of the tags, in record order."""
    return F.filter(F.coalesce(rec["datafield"], F.array().cast("array<struct<tag:string,ind1:string,ind2:string,subfield:array<struct<code:string,value:string>>>>")), lambda f: f["tag"].isin(*tags))


def codes(field: Column, *wanted: str) -> Column:
    """Values of a field's subfields of the codes, in order."""
    return F.transform(F.filter(field["subfield"], lambda s: s["code"].isin(*wanted) & s["value"].isNotNull()), lambda s: s["value"])


def values(rec: Column, tag: str, *wanted: str) -> Column:
    """Values of subfields of all fields of a tag."""
    return F.flatten(F.transform(fields(rec, tag), lambda f: codes(f, *wanted)))


def first(rec: Column, tag: str, *wanted: str) -> Column:
    return F.try_element_at(values(rec, tag, *wanted), F.lit(1))


def leader_at(rec: Column, position: int) -> Column:
    return F.lower(F.substring(rec["leader"], position, 1))


def schema(rec: Column) -> Column:
    """``rusmarc`` or ``marc21``, by the shape of 100$a and the tags at hand."""
    # 100$a of RUSMARC is a date of entry, a letter for the kind of date, and codes up to 36 signs in all.
    dated = lambda coded: F.length(coded).between(34, 36) & F.substring(coded, 1, 8).try_cast("int").isNotNull() & F.rlike(F.substring(coded, 9, 1), F.lit("[A-Za-z]"))
    entered = let(F.array_join(values(rec, "100", "a"), ""), dated)
    some = control(rec, "007").isNotNull() | control(rec, "008").isNotNull() | (F.size(fields(rec, "040", "852", "856")) > 0)
    return F.when(entered, "rusmarc").when(some, "marc21").when(rec["leader"].isNotNull(), "rusmarc").otherwise("marc21")


def record_type(rec: Column) -> Column:
    """The group of the leader's type: bibliographic, authority, holdings, community, classification or unknown."""
    return let(leader_at(rec, TYPE), _type_group)


def _type_group(t: Column) -> Column:
    return (
        F.when(t.isin(*BIBLIOGRAPHIC_TYPES), "bibliographic").when(t.isin(*AUTHORITY_TYPES), "authority").when(t.isin(*HOLDINGS_TYPES), "holdings")
        .when(t.isin(*COMMUNITY_TYPES), "community").when(t.isin(*CLASSIFICATION_TYPES), "classification").otherwise("unknown")
    )


def kind(rec: Column) -> Column:
    """``collection`` or ``instance`` by the bibliographic level, else the record type."""
    level = F.when(leader_at(rec, LEVEL).isin(*COLLECTION_LEVELS), "collection").otherwise("instance")
    return let(record_type(rec), lambda t: F.when(t == "bibliographic", level).otherwise(t))


def source(rec: Column, default: Column | None = None) -> Column:
    """Who issued the record: the code of the first of ``SOURCE_PLACES`` that has one; '' if it isn't a code.

    A field of legal deposit, 017, tells by its last $b, and only beside a number in $a.
    """
    def at(place: str) -> Column:
        tag, _, code = place.partition("$")
        if not code:
            return control(rec, tag)
        if tag == "017":
            numbered = F.filter(fields(rec, tag), lambda f: F.size(codes(f, "a")) > 0)
            return F.try_element_at(F.flatten(F.transform(numbered, lambda f: codes(f, code))), F.lit(-1))
        return first(rec, tag, code)

    code = F.coalesce(*[F.nullif(at(place), F.lit("")) for place in SOURCE_PLACES], *([default] if default is not None else []), F.lit(""))
    known = F.create_map(*[F.lit(x) for p in SOURCE_FIXES.items() for x in p])
    fixed = let(code, lambda c: F.coalesce(F.try_element_at(known, c), c))
    return let(fixed, lambda c: F.when(F.rlike(c, F.lit(SOURCE_CODE)), c).otherwise(""))


def source_code(code: Column) -> Column:
    """A library's code for any of its spellings; other codes as they are."""
    table = F.create_map(*[F.lit(x) for p in SOURCE_CODES.items() for x in p])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(code))), code)


def key(rec: Column) -> Column:
    return F.coalesce(control(rec, "001"), F.lit(""))


def dates(rec: Column) -> Column:
    """Struct of a record's dates: of the record itself, of publication and of what the coded ranges tell."""
    return let(rec, _dates)


def _dates(rec: Column) -> Column:
    texts = F.concat(values(rec, "260", "c"), values(rec, "260", "g"), values(rec, "901", "c"), values(rec, "210", "d"))
    published = F.try_element_at(F.filter(F.transform(texts, lambda t: parse_date(t)), lambda d: d.isNotNull()), F.lit(1))
    return let(F.struct(
        (schema(rec) == "marc21").alias("is21"), control(rec, "008").alias("f008"), first(rec, "100", "a").alias("f100"), record_type(rec).alias("type"), leader_at(rec, STATUS).alias("status"),
        parse_date(control(rec, "005")).alias("updated"), parse_date(first(rec, "801", "c")).alias("listed"), published.alias("published"),
    ), _with_first_date)


def _with_first_date(a: Column) -> Column:
    by008 = a["is21"] & a["f008"].isNotNull()
    return let(F.when(by008, parse_date(F.substring(a["f008"], 1, 6))), lambda began008: _with_coded_dates(a, by008, began008))


def _with_coded_dates(a: Column, by008: Column, began008: Column) -> Column:
    f008, f100 = a["f008"], a["f100"]
    use100 = began008.isNull() & f100.isNotNull()
    began = F.coalesce(began008, F.when(f100.isNotNull(), parse_date(F.substring(f100, 1, 8))), a["listed"])
    table = F.create_map(*[F.lit(x) for p in RUSMARC_TYPES.items() for x in p])
    code = F.when(use100, F.try_element_at(table, F.lower(F.substring(f100, 9, 1)))).when(by008 & (a["type"] == "bibliographic"), F.lower(F.substring(f008, 7, 1)))
    digits = F.when(use100, F.substring(f100, 10, 8)).when(by008, F.substring(f008, 8, 8))

    def told(v: Column) -> Column:
        coded, updated, published = v["coded"], a["updated"], a["published"]
        start = F.coalesce(coded["date_start"], published)
        return F.struct(
            updated.alias("record_updated"), F.coalesce(v["began"], updated, published).alias("record_start"),
            F.when(a["status"] == "d", updated).alias("record_end"), published.alias("published"),
            F.when(start > coded["date_end"], coded["date_end"]).otherwise(start).alias("date_start"),
            *[coded[f].alias(f) for f in ("date_end", "date2_start", "date2_end", "reissue_start", "reissue_end", "copyright_start", "copyright_end", "date_production", "date_distribution", "other_field")],
        )

    return let(F.struct(coded_dates(code, digits).alias("coded"), began.alias("began")), told)


def links(rec: Column) -> Column:
    """URLs of 856$u with their text and type."""
    return F.flatten(F.transform(fields(rec, "856"), lambda f: F.transform(codes(f, "u"), lambda u: F.struct(u.alias("href"), F.array_join(codes(f, "3", "x"), "-").alias("title"), F.try_element_at(codes(f, "q"), F.lit(1)).alias("type"), f["ind2"].alias("ind2")))))


def items(rec: Column) -> Column:
    """Copies of 852/853: source $a beside key $j."""
    return F.flatten(F.transform(fields(rec, "852", "853"), lambda f: F.filter(F.zip_with(codes(f, "a"), codes(f, "j"), lambda a, j: F.struct(a.alias("source"), j.alias("key"))), lambda p: p["source"].isNotNull() & p["key"].isNotNull())))


def collections(rec: Column) -> Column:
    return F.array_distinct(values(rec, "979", "a"))
