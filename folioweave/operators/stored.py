"""Deletes on stored tables: only the partitions of kinds that lose rows are rewritten."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import checkpointed, matching
from .stats import Ledger
from .store import GraphStore

_PARTS = {"anchors": ["kind"], "details": ["kind"], "relations": ["kind_from", "kind_to"]}


def _rewrite(spark: SparkSession, path: str, rows: DataFrame, gone: Column, parts: list[str]) -> int:
    """Take the rows ``gone`` from a table partitioned by ``parts``; the number of partitions rewritten.

    Partitions that lose nothing aren't touched. Those that keep some rows are overwritten by them, all in one commit;
    those that keep none are removed.
    """
    touched = rows.groupBy(*parts).agg(F.count_if(gone).alias("lost"), F.count_if(~gone).alias("left")).where("lost > 0").collect()  # a row a partition
    same = lambda r: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in parts])
    some = [r for r in touched if r["left"]]
    if some:
        # Written aside first: a table can't be read while it is overwritten.
        kept = checkpointed(rows.where(reduce(lambda a, b: a | b, [same(r) for r in some])).where(~gone))
        order = ["serial"] if "serial" in rows.columns else []
        kept.sortWithinPartitions(*parts, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    for r in touched:
        if not r["left"]:
            names = [f"{c}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r[c])}" for c in parts]
            where = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *names]))
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(touched)


def delete_stored(spark: SparkSession, path: str, kind: str, source: str | None = None, key: str | None = None, ledger: Ledger | None = None, number: int | None = None) -> dict[str, int]:
    """Delete a kind, source or node with its details and edges from the store that ``GraphStore.write`` wrote below ``path``.

    Returns how many partitions of each table were rewritten; files of all others stay as they are. Edges go first,
    anchors last, so that a delete that is cut short leaves no edge without its ends and can run again. With a ``ledger``
    the removed rows' daily counts are recorded as batch ``number`` before anything is removed, and not again.
    """
    store = GraphStore.read(spark, path)
    own, ends = matching(kind, source, key), matching(kind, source, key, "_from") | matching(kind, source, key, "_to")
    if ledger is not None and not ledger.recorded(number):
        ledger.record(number, removed=GraphStore(store.anchors.where(own), store.details.where(own), store.relations.where(ends)))
    # Only partitions of the kind are looked at.
    edges = store.relations.where((F.col("kind_from") == kind) | (F.col("kind_to") == kind))
    done = {"relations": _rewrite(spark, f"{path}/relations", edges, ends, _PARTS["relations"])}
    for name in ("details", "anchors"):
        done[name] = _rewrite(spark, f"{path}/{name}", getattr(store, name).where(F.col("kind") == kind), own, _PARTS[name])
    return done
