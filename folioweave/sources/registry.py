"""Media types: what a record's text looks like, and how a raw file splits into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TSV, MARC, MARCXML = "text/tab-separated-values", "application/marc", "application/marcxml+xml"
ATOM, OPDS, QUADS = "application/atom+xml", "application/opds+json", "application/n-quads"
ONIX, LITRES, JES = "application/vnd.editeur.org+xml", "application/vnd.litres.publication+xml", "application/vnd.jes.journal+xml"
REGISTRY, JSON, LD_JSON, YAML, XML, RDF, HTML = (
    "application/vnd.registry-dump+json", "application/json", "application/ld+json", "application/yaml", "text/xml", "application/rdf+xml", "text/html",
)

#: Element that holds one record, for the XML formats.
ROW_TAG = {MARCXML: "record", ATOM: "entry", LITRES: "updated-book", JES: "journal", ONIX: "Product"}
#: What ends a record, for the formats that are split by a marker.
RECORD_END = {MARC: "\x1d", QUADS: "\n", TSV: "\n"}


def sniff(record: Column) -> Column:
    """A record's media type by its looks; null for an empty one, ``text/plain`` for an unknown one."""
    s = F.trim(F.regexp_replace(record, r"^﻿", ""))
    has = lambda rx: F.rlike(s, F.lit(rx))
    return (
        F.when(record.isNull() | (s == ""), F.lit(None).cast("string"))
        .when(has(r"^\d{5}[a-z ][a-z ][a-z #|].{4}\d{5}"), MARC)
        .when(has(r"(?s)^(?:<\?xml[^>]*>\s*)?<(?:\w+:)?(?:collection|record)\b.*<(?:\w+:)?leader"), MARCXML)
        .when(has(r"(?s)^(?:<\?xml[^>]*>\s*)?(?:<!DOCTYPE[^>]*>\s*)?<(?:ONIXMessage|ONIXmessage|Product|product)\b"), ONIX)
        .when(has(r"(?s)^(?:<\?xml[^>]*>\s*)?<(?:feed|entry)\b"), ATOM)
        .when(has(r"(?s)^(?:<\?xml[^>]*>\s*)?<(?:updated-book|removed-book|catalit)\b"), LITRES)
        .when(has(r"(?s)^(?:<\?xml[^>]*>\s*)?<journals?\b"), JES)
        .when(has(r"(?s)^(?:<\?xml[^>]*>\s*)?<rdf:RDF\b"), RDF)
        .when(has(r"(?is)^(?:<!doctype html|<html)\b"), HTML)
        .when(has(r"^<\?xml\b"), XML)
        .when(has(r'(?s)^[\[{].*"@context"'), LD_JSON)
        .when(has(r'(?s)^[\[{].*"metadata"\s*:'), OPDS)
        .when(has(r'(?s)^\{.*"copies"\s*:.*"parts"\s*:'), REGISTRY)
        .when(has(r"(?s)^[\[{].*[\]}]$"), JSON)
        .when(has(r"^(?:<[^>]+>|_:\S+)\s+<[^>]+>\s+(?:<[^>]+>|_:\S+|\").*\.\s*(?:\n|$)"), QUADS)
        .when(has(r"^[^\n\t]+\t[^\n]+"), TSV)
        .when(has(r"(?s)^---\s*\n"), YAML)
        .otherwise("text/plain")
    )


def read_records(spark: SparkSession, path: str, media_type: str, limit: int | None = None) -> DataFrame:
    """Raw records (record, media_type) of marker-separated files; gzip files are read as they are."""
    if media_type not in RECORD_END:
        raise ValueError(f"{media_type} has a reader of its own")
    rows = spark.read.option("lineSep", RECORD_END[media_type]).text(path).where("trim(value) <> ''")
    rows = rows.select(F.col("value").alias("record"), F.lit(media_type).alias("media_type"))
    return rows if limit is None else rows.limit(limit)


def read_xml_records(spark: SparkSession, path: str, media_type: str, schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Records of an XML format, one row for each of its record elements."""
    reader = spark.read.format("xml").option("rowTag", ROW_TAG[media_type]).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).load(path)
