"""N-Quads: statements by regular expression, one entity for each subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import uri_to_node
from .registry import QUADS

_STATEMENT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'


def quad(line: Column) -> Column:
    """Struct (subject, predicate, object, language, graph) of a statement; null for other lines."""
    at = lambda k: F.regexp_extract(line, _STATEMENT, k)
    bare = lambda c: F.regexp_replace(c, r"^<|>$", "")
    literal = F.regexp_extract(at(3), r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    for escape, sign in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r'\\"', '"'), (r"\\\\", r"\\")):
        literal = F.regexp_replace(literal, escape, sign)
    language = F.regexp_extract(at(3), r"\"@([A-Za-z0-9-]+)$", 1)
    return F.when(F.rlike(line, F.lit(_STATEMENT)), F.struct(
        bare(at(1)).alias("subject"), at(2).alias("predicate"), F.when(F.startswith(at(3), F.lit('"')), literal).otherwise(bare(at(3))).alias("object"),
        F.when(language != "", language).alias("language"), F.when(at(4) != "", bare(at(4))).alias("graph"),
    ))


def subjects(lines: DataFrame, line: str = "record") -> DataFrame:
    """Rows (subject, statements, record): all statements of a subject in the order of their text."""
    own = lines.select(F.col(line).alias("line"), quad(F.col(line)).alias("q")).where("q IS NOT NULL")
    kept = own.groupBy("q.subject").agg(F.array_sort(F.collect_set(F.struct("line", "q"))).alias("s"))
    return kept.select("subject", F.transform("s", lambda x: x["q"]).alias("statements"), F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("record"))


def tuples(lines: DataFrame, line: str = "record", prefixes: dict[str, str] | None = None) -> DataFrame:
    """Entity tuples, one a subject."""
    node = uri_to_node(F.col("subject"), prefixes)
    return subjects(lines, line).select(node.alias("n"), "record").select("n.*", "record", F.lit(QUADS).alias("media_type"))


def labels(statements: Column, predicate_end: str) -> Column:
    """Objects of the predicates that end in a name, as structs (object, language)."""
    return F.transform(F.filter(statements, lambda q: F.endswith(q["predicate"], F.lit(predicate_end))), lambda q: F.struct(q["object"].alias("object"), q["language"].alias("language")))
