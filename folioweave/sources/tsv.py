"""Tab-separated values: dotted headers, the column data format, and the writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE, NODE
from .registry import TSV

_CELL = "\t"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows (header, line, cells, pos): each file's lines split at tabs, with the file's header.

    Lines are read in splits; the header is each file's first line, found by its place in the file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        F.regexp_replace("value", "\r", "").alias("line"),
    ).where("trim(line) <> ''")
    heads = lines.groupBy("file").agg(F.min(F.struct("at", "line")).alias("head")).select("file", "head.*").withColumnRenamed("line", "header").withColumnRenamed("at", "first")
    body = lines.join(F.broadcast(heads), "file").where(F.col("at") > F.col("first"))
    return body.select("file", "header", "line", F.transform(F.split("header", _CELL), lambda n: F.trim(n)).alias("names"), F.split("line", _CELL).alias("cells"), F.col("at.row").alias("pos"))


def cell(name: str) -> Column:
    """The value of a named column; null if it is missing or blank."""
    value = F.get(F.col("cells"), (F.array_position("names", name) - 1).cast("int"))
    return F.when(F.trim(value) != "", value)


def tuples(rows: DataFrame, source: str | None = None) -> DataFrame:
    """Entity and relation tuples of the rows of ``read_tsv``; a record is its header and line."""
    columns = {c: cell(c) for c in dict.fromkeys([*NODE, *EDGE, "provider", "media_type"])}
    edge = columns["kind_from"].isNotNull() & columns["kind_to"].isNotNull()
    stamp = F.try_to_timestamp(cell("time_source")).cast("timestamp_ntz")
    out = rows.select(*[v.alias(k) for k, v in columns.items()], stamp.alias("time_source"), F.col("pos").alias("input_pos"), F.when(~edge, F.concat_ws("\n", "header", "line")).alias("record"))
    return out.withColumns({"media_type": F.coalesce("media_type", F.lit(TSV)), "source": F.coalesce("source", F.lit(source))})


def is_column_format(rows: DataFrame) -> Column:
    """Whether a header has both of the columns ``value`` and ``path``."""
    return F.array_contains("names", "value") & F.array_contains("names", "path")


def column_format_records(rows: DataFrame) -> DataFrame:
    """Lines of one node each, gathered: (kind, source, key, record), the record in line order under its header."""
    own = rows.where(is_column_format(rows)).select(cell("kind").alias("kind"), cell("source").alias("source"), cell("key").alias("key"), "header", "line", "pos")
    return own.groupBy(*NODE).agg(F.min_by("header", "pos").alias("header"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls")).select(
        *NODE, F.concat_ws("\n", F.col("header"), F.transform("ls", lambda x: x["line"])).alias("record")
    )


def nested_json(names: Column, cells: Column) -> Column:
    """A row as JSON, ``a.b`` columns as members of ``a``; blank cells are left out. Two levels deep."""
    kept = F.filter(F.arrays_zip(names.alias("k"), cells.alias("v")), lambda p: F.trim(p["v"]) != "")
    head = lambda k: F.substring_index(k, ".", 1)
    tail = lambda k: F.substr(k, F.length(head(k)) + 2)
    quoted = lambda x: F.to_json(F.map_from_arrays(F.array(F.lit("x")), F.array(x)))
    bare = lambda x: F.regexp_extract(quoted(x), r"(?s)^\{\"x\":(.*)\}$", 1)
    groups = F.array_distinct(F.transform(kept, lambda p: head(p["k"])))

    def member(g: Column) -> Column:
        own = F.filter(kept, lambda p: head(p["k"]) == g)
        plain = F.filter(own, lambda p: p["k"] == g)
        inner = F.array_join(F.transform(own, lambda p: F.concat(bare(tail(p["k"])), F.lit(":"), bare(p["v"]))), ",")
        value = F.when(F.size(plain) > 0, bare(F.element_at(plain, -1)["v"])).otherwise(F.concat(F.lit("{"), inner, F.lit("}")))
        return F.concat(bare(g), F.lit(":"), value)

    return F.concat(F.lit("{"), F.array_join(F.transform(groups, member), ","), F.lit("}"))


def write_tsv(rows: DataFrame, path: str) -> None:
    """Columns in order of name; timestamps in ISO form, nulls as nothing."""
    flat = []
    for name, kind in sorted(rows.dtypes):
        c = F.col(name)
        flat.append((F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if kind.startswith("timestamp") else F.to_json(c) if kind[:5] in ("struc", "array", "map<s") else c.cast("string")).alias(name))
    rows.select(*flat).write.option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)
