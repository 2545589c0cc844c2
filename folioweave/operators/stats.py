"""Daily counts and their roll-ups, field statistics, batch reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import GraphStore


def daily_details(details: DataFrame) -> DataFrame:
    """Details by kind, source, provider and day."""
    return details.groupBy("kind", "source", "provider", F.date_trunc("day", "time_sys").cast("timestamp_ntz").alias("since")).agg(F.count("*").alias("cnt"))


def daily_relations(relations: DataFrame) -> DataFrame:
    """Edges by kinds, sources, relation kind, provider and day."""
    day = F.date_trunc("day", "time_sys").cast("timestamp_ntz").alias("since")
    return relations.groupBy("kind_from", "kind_to", "source_from", "source_to", "relation_kind", "provider", day).agg(F.count("*").alias("cnt"))


def rolled_up(daily: DataFrame, by: list[str], since=None, until=None, least: int = 1) -> DataFrame:
    """Sums of daily counts within inclusive bounds, of ``least`` or more."""
    rows = daily if since is None else daily.where(F.col("since") >= F.lit(since))
    rows = rows if until is None else rows.where(F.col("since") <= F.lit(until))
    return rows.groupBy(*by).agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= least)


def totals(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Of each roll-up the number of groups and the sum of counts."""
    line = lambda df, name: df.agg(F.count("*").alias("groups"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total")).select(F.lit(name).alias("what"), "groups", "total")
    return line(entities, "entities").unionByName(line(relations, "relations"))


def merged_daily(stored: DataFrame, added: DataFrame) -> DataFrame:
    """A stored daily table refreshed by the counts of new rows only."""
    by = [c for c in stored.columns if c != "cnt"]
    return stored.unionByName(added).groupBy(*by).agg(F.sum("cnt").alias("cnt"))


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Daily counts as a change: of rows added (1) or removed (-1)."""
    return rows.withColumn("cnt", sign * F.col("cnt"))


def _netted(rows: DataFrame) -> DataFrame:
    """Changes of the same counters added up; those that cancel out go."""
    by = [c for c in rows.columns if c != "cnt"]
    return rows.groupBy(*by).agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


def changes(added: GraphStore | None = None, removed: GraphStore | None = None) -> tuple[DataFrame, DataFrame]:
    """How the daily counts of details and of relations change by what is added and removed: only those rows are read."""
    sides = [(store, sign) for store, sign in ((added, 1), (removed, -1)) if store is not None]
    of = lambda daily, table: _netted(reduce(DataFrame.unionByName, [signed(daily(getattr(store, table)), sign) for store, sign in sides]))
    return of(daily_details, "details"), of(daily_relations, "relations")


@dataclass(frozen=True)
class Ledger:
    """Daily counts kept as changes by batch number below ``path``, so that adding or deleting reads no other rows.

    A batch's changes are written in place of any that its number had before: one that runs again counts once.
    ``compact`` adds up the changes to a number; readers take the last sum and the changes after it.
    """

    spark: SparkSession
    path: str

    def _of(self, name: str) -> DataFrame | None:
        """Changes of the last sum and of batches after it."""
        base = self._last(f"{self.path}/sums")
        found = []
        for where, wanted in ((f"{self.path}/sums", lambda n: n == base), (f"{self.path}/changes", lambda n: base is None or n > base)):
            own = [f"{where}/batch={n}/{name}" for n in self._numbers(where) if wanted(n)]
            # A folder that the job that wrote it didn't finish has no mark.
            own = [p for p in own if self._exists(f"{p}/_SUCCESS")]
            found += [self.spark.read.parquet(*own)] if own else []
        return reduce(DataFrame.unionByName, found) if found else None

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, where: str) -> bool:
        fs, path = self._fs(where)
        return fs.exists(path)

    def _numbers(self, where: str) -> list[int]:
        fs, path = self._fs(where)
        return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _last(self, where: str) -> int | None:
        """The last number whose sums are whole."""
        done = [n for n in self._numbers(where) if all(self._exists(f"{where}/batch={n}/{t}/_SUCCESS") for t in ("details", "relations"))]
        return max(done, default=None)

    def recorded(self, number: int) -> bool:
        """Whether batch ``number`` is recorded whole."""
        last = self._last(f"{self.path}/sums")
        return last is not None and number <= last or all(self._exists(f"{self.path}/changes/batch={number}/{t}/_SUCCESS") for t in ("details", "relations"))

    def record(self, number: int, added: GraphStore | None = None, removed: GraphStore | None = None) -> None:
        """Write what batch ``number`` changes. Numbers up to the last sum are settled and can't be recorded again."""
        last = self._last(f"{self.path}/sums")
        if last is not None and number <= last:
            raise ValueError(f"batch {number} is settled: sums reach to {last}")
        for name, rows in zip(("details", "relations"), changes(added, removed), strict=True):
            rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={number}/{name}")

    def daily(self) -> tuple[DataFrame, DataFrame]:
        """The daily counts of details and of relations now."""
        empty = {"details": _DAILY_DETAILS, "relations": _DAILY_RELATIONS}
        found = [(name, self._of(name)) for name in ("details", "relations")]
        return tuple(self.spark.createDataFrame([], empty[name]) if rows is None else _netted(rows) for name, rows in found)

    def compact(self, until: int) -> None:
        """Add up all changes to number ``until``; those files may be removed once no reader is left that began before."""
        base = self._last(f"{self.path}/sums")
        for name in ("details", "relations"):
            own = [f"{self.path}/changes/batch={n}/{name}" for n in self._numbers(f"{self.path}/changes") if n <= until and (base is None or n > base)]
            own += [f"{self.path}/sums/batch={base}/{name}"] if base is not None else []
            if own:
                _netted(self.spark.read.parquet(*own)).write.mode("overwrite").parquet(f"{self.path}/sums/batch={until}/{name}")


_DAILY_DETAILS = "kind string, source string, provider string, since timestamp_ntz, cnt long"
_DAILY_RELATIONS = "kind_from string, kind_to string, source_from string, source_to string, relation_kind string, provider string, since timestamp_ntz, cnt long"


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def field_statistics(values: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Of each field: occurrences, first and last value in order, and characters in all."""
    return values.groupBy(*by).agg(
        F.count("*").alias("occurrences"), F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"),
        F.sum(F.length(value).cast("long")).alias("symbols"),
    )


def marc_field_statistics(records: DataFrame, record: str = "marc", order: str = "pos", record_type: Column | None = None) -> DataFrame:
    """``field_statistics`` of MARC records by record type and field ("245$a", "001")."""
    kind = F.substring(F.col(f"{record}.leader"), 7, 1) if record_type is None else record_type
    base = records.where(F.col(f"{record}.leader").isNotNull()).select(kind.alias("record_type"), F.col(order).alias("pos"), F.col(record).alias("m"))
    control = base.select("record_type", "pos", F.posexplode("m.controlfield").alias("i", "f")).select("record_type", F.struct("pos", "i", F.lit(-1).alias("j")).alias("at"), F.col("f.tag").alias("field"), F.col("f.value").alias("value"))
    data = base.select("record_type", "pos", F.posexplode("m.datafield").alias("i", "f")).select("record_type", "pos", "i", "f.tag", F.posexplode("f.subfield").alias("j", "s"))
    data = data.select("record_type", F.struct("pos", "i", "j").alias("at"), F.concat_ws("$", "tag", "s.code").alias("field"), F.col("s.value").alias("value"))
    return field_statistics(control.unionByName(data).where("value IS NOT NULL"), ["record_type", "field"], "value", "at")


def merged_reports(reports: DataFrame) -> DataFrame:
    """Import reports (class, kind, total, affected) of several batches as one."""
    return reports.groupBy("class", "kind").agg(F.sum("total").alias("total"), F.sum("affected").alias("affected"))


def log_weights(rows: DataFrame, by: str) -> DataFrame:
    """The natural logarithm of how many rows each value of ``by`` has, as a weight."""
    return rows.groupBy(by).agg(F.log(F.count("*").cast("double")).alias("weight"))
