"""Continuous import: a stream of tuples, upserted batch by batch; daily counts of a stream.

Redelivered tuples change nothing, since an import keeps what the store lacks only. Each batch is
written once under its number, so a batch that is run again replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import ANCHOR, DETAIL, RELATION, TUPLE
from ..operators.ingest import removal, upsert
from ..operators.stats import Ledger
from ..operators.store import GraphStore

_TABLES = {"anchors": ANCHOR, "details": DETAIL, "relations": RELATION}
_DELETED = "kind string, source string, key string, batch long"


def _read(spark: SparkSession, path: str, name: str, own: str) -> DataFrame:
    rows = spark.read.schema(own).option("basePath", f"{path}/{name}").option("ignoreMissingFiles", True)
    try:
        return rows.parquet(f"{path}/{name}")
    except Exception as e:  # a table has no files before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], own)


def _kept(rows: DataFrame, deleted: DataFrame, end: str = "") -> DataFrame:
    """``rows`` without those that a later batch deletes, by kind, source or node of one end."""
    for names in (["kind"], ["kind", "source"], ["kind", "source", "key"]):
        absent = [c for c in ("source", "key") if c not in names]
        exact = deleted.where(" AND ".join([f"{c} IS NULL" for c in absent] + [f"{c} IS NOT NULL" for c in names]))
        last = exact.groupBy(*[F.col(c).alias(f"__{c}") for c in names]).agg(F.max("batch").alias("__batch"))
        same = [F.col(f"{c}{end}") == F.col(f"__{c}") for c in names]
        rows = rows.join(last, [*same, F.col("batch") < F.col("__batch")], "left_anti")
    return rows


def stored(spark: SparkSession, path: str, before: int | None = None) -> GraphStore:
    """The store below ``path``, of batches before a number if given, without what later batches deleted."""
    until = F.lit(True) if before is None else F.col("batch") < before
    deleted = _read(spark, path, "deleted", _DELETED).where(until)
    found = []
    for name, schema in _TABLES.items():
        own = f"{schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, batch long"
        rows = _read(spark, path, name, own).where(until)
        for end in ("_from", "_to") if name == "relations" else ("",):
            rows = _kept(rows, deleted, end)
        found.append(rows.drop("batch"))
    return GraphStore(*found)


def _largest(spark: SparkSession, path: str, number: int) -> dict[str, int]:
    """The largest serial of each table of batches before ``number``, deleted rows included, so that none is given twice."""
    own = {name: _read(spark, path, name, "serial long, batch long").where(F.col("batch") < number).agg(F.max("serial").alias("m")) for name in _TABLES}
    return {name: rows.first()["m"] or 0 for name, rows in own.items()}


def import_batch(batch: DataFrame, number: int, path: str, provider: str | None = None, now=None) -> None:
    """Append one batch's new rows to the store below ``path``, and its changes to the daily counts."""
    spark = batch.sparkSession
    new = upsert(batch, stored(spark, path, number), provider, now, _largest(spark, path, number))
    for name, rows in (("anchors", new.anchors), ("details", new.details), ("relations", new.relations)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    # The rows as they were written, so that the counts are theirs.
    own = {name: _read(spark, path, name, f"{_TABLES[name].simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, batch long").where(F.col("batch") == number).drop("batch") for name in _TABLES}
    counts(spark, path).record(number, added=GraphStore(**own))


def delete_batch(spark: SparkSession, number: int, path: str, kind: str, source: str | None = None, key: str | None = None) -> None:
    """Delete a kind, source or node, with its details and edges, as batch ``number`` of the store below ``path``.

    No file of the store is rewritten: the deletion is a row that readers heed, and the removed rows' daily counts are
    taken off. A batch that runs again takes the place of its first run; what is imported later stays.
    """
    gone = removal(stored(spark, path, number), kind, source, key)
    counts(spark, path).record(number, removed=gone)
    spark.createDataFrame([(kind, source, key)], "kind string, source string, key string").write.mode("overwrite").parquet(f"{path}/deleted/batch={number}")


def counts(spark: SparkSession, path: str) -> Ledger:
    """The daily counts of the store below ``path``."""
    return Ledger(spark, f"{path}/counts")


def stream_tuples(spark: SparkSession, source: str, path: str, checkpoint: str, provider: str | None = None, now=None) -> StreamingQuery:
    """Import JSON tuples that arrive in a folder, until stopped or, as it is started here, all are read."""
    rows = spark.readStream.schema(TUPLE).json(source)
    return rows.writeStream.foreachBatch(lambda df, n: import_batch(df, n, path, provider, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, time: str, by: list[str], late: str = "1 day") -> DataFrame:
    """Counts of a stream by day and columns; rows later than ``late`` are dropped by the watermark."""
    day = F.window(time, "1 day")
    return events.withWatermark(time, late).groupBy(day.alias("day"), *by).agg(F.count("*").alias("cnt")).select(F.col("day.start").alias("since"), *by, "cnt")


def first_deliveries(events: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """A stream's rows once each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
