"""Linking entries of MARC records as edges, and their targets among the anchors.

A rule table of tags and second indicators tells what relation a field states; a rule without an indicator holds for
all those that have none of their own. A field's control numbers name the other record, with the code of the library
that issued it in brackets or, without one, in the record's own source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import marc as M
from ..model import EDGE, NODE

# Fixed values of the format: tag, second indicator or None for any other, relation.
RULES = (
    ("765", None, "translationOf"),
    ("767", None, "translation"),
    ("770", None, "supplement"),
    ("772", None, "supplementTo"),
    ("773", None, "partOf"),
    ("774", None, "hasPart"),
    ("775", None, "otherEdition"),
    ("777", None, "issuedWith"),
    ("780", "0", "continues"),
    ("780", "1", "continuesInPart"),
    ("780", "4", "mergerOf"),
    ("780", "5", "absorbed"),
    ("780", "6", "absorbed"),
    ("780", "7", "separatedFrom"),
    ("780", None, "precededBy"),
    ("785", "0", "continuedBy"),
    ("785", "1", "continuedInPartBy"),
    ("785", "4", "absorbedBy"),
    ("785", "5", "absorbedBy"),
    ("785", "6", "splitInto"),
    ("785", "7", "mergedToForm"),
    ("785", "8", "continuedBy"),
    ("785", None, "succeededBy"),
    ("786", None, "source"),
    ("787", None, "relatedTo"),
)
TAGS = tuple(dict.fromkeys(tag for tag, _, _ in RULES))
#: Fixed value: a control number with its library's code in brackets.
NUMBERED = r"^\s*\(([^)]+)\)(.+)$"
_ENTRY = "struct<tag:string,ind2:string,source:string,key:string>"


def entries(rec: Column, source: Column) -> Column:
    """The linking entries of a record: an array of (tag, ind2, source, key), one for each control number that isn't blank."""

    def of(field: Column) -> Column:
        number = lambda w: F.struct(
            field["tag"].alias("tag"), field["ind2"].alias("ind2"),
            F.lower(F.trim(F.when(F.rlike(w, F.lit(NUMBERED)), M.source_code(F.regexp_extract(w, NUMBERED, 1))).otherwise(source))).alias("source"),
            F.lower(F.trim(F.when(F.rlike(w, F.lit(NUMBERED)), F.regexp_extract(w, NUMBERED, 2)).otherwise(w))).alias("key"),
        )
        return F.transform(F.filter(M.codes(field, "w"), lambda w: F.trim(w) != ""), number)

    return F.flatten(F.transform(M.fields(rec, *TAGS), of)).cast(f"array<{_ENTRY}>")


def rules(spark: SparkSession, given: tuple = RULES) -> DataFrame:
    """The rule table: (tag, ind2, relation_kind), ``ind2`` null in the rule for any other indicator."""
    return spark.createDataFrame(list(given), "tag string, ind2 string, relation_kind string")


def linking_edges(records: DataFrame, given: tuple = RULES) -> DataFrame:
    """Edges of the linking entries of records (marc, pos), with their provider null and ``input_pos`` that of the record.

    The other record is taken to be of the record's own kind, until ``resolved`` finds it. Entries of tags without a
    rule, and records without a source or key, give none.
    """
    m = F.col("marc")
    own = records.select(F.col("pos").alias("input_pos"), F.lower(M.kind(m)).alias("kind"), F.lower(M.source(m)).alias("source"), F.lower(M.key(m)).alias("key"), "marc")
    found = own.where((F.col("source") != "") & (F.col("key") != "")).select("input_pos", *NODE, F.explode(entries(m, F.col("source"))).alias("e"))
    table = rules(records.sparkSession, given)
    exact, other = table.where("ind2 IS NOT NULL"), table.where("ind2 IS NULL")
    named = exact.select(F.col("tag").alias("t1"), F.col("ind2").alias("i1"), F.col("relation_kind").alias("r1"))
    # Both tables are fixed and of a few rows.
    hit = found.join(F.broadcast(named), (F.col("e.tag") == F.col("t1")) & (F.col("e.ind2") == F.col("i1")), "left")
    hit = hit.join(F.broadcast(other.select(F.col("tag").alias("t2"), F.col("relation_kind").alias("r2"))), F.col("e.tag") == F.col("t2"), "left")
    kind = F.coalesce("r1", "r2")
    return hit.where(kind.isNotNull()).select(
        F.col("kind").alias("kind_from"), F.col("source").alias("source_from"), F.col("key").alias("key_from"), kind.alias("relation_kind"),
        F.col("kind").alias("kind_to"), F.col("e.source").alias("source_to"), F.col("e.key").alias("key_to"), F.lit(None).cast("string").alias("provider"), "input_pos",
    )


def resolved(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """``edges`` with ``found``: whether their target is an anchor, of the kind that the edge says or else of another.

    An edge's ``kind_to`` becomes the kind of its target; of several other kinds the least in order. Edges whose
    target is nowhere keep theirs.
    """
    own = anchors.select(*[F.col(c).alias(f"{c}_to") for c in NODE]).distinct()
    of_any = own.groupBy("source_to", "key_to").agg(F.min("kind_to").alias("__any"), F.collect_set("kind_to").alias("__kinds"))
    hit = edges.join(of_any, ["source_to", "key_to"], "left")
    same = F.coalesce(F.array_contains("__kinds", F.col("kind_to")), F.lit(False))
    return hit.withColumns({"found": F.col("__any").isNotNull(), "kind_to": F.when(same, F.col("kind_to")).otherwise(F.coalesce("__any", "kind_to"))}).select(*edges.columns, "found")


def unresolved(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """What linking entries ask for that no anchor is: (relation_kind, source_to, missing, targets), counts of edges and of records."""
    lost = resolved(edges, anchors).where(~F.col("found"))
    return lost.groupBy("relation_kind", "source_to").agg(F.count("*").alias("missing"), F.countDistinct("key_to").alias("targets"))


def linking_tuples(edges: DataFrame) -> DataFrame:
    """Relation tuples of the edges, as import takes them."""
    blank = [F.lit(None).cast("string").alias(c) for c in (*NODE, "record", "media_type")]
    return edges.select(*blank, *EDGE, "provider", F.lit(None).cast("timestamp_ntz").alias("time_source"), "input_pos")
