"""Idempotent import: classify tuples, keep the first of each key, append what is new.

Serials are dense and follow the batch's order by key. They are minted by counting: each partition's
rows are ranked within it and shifted by the counts of the partitions before, so no single task
sees the whole batch.
"""

from __future__ import annotations

import tempfile
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DETAIL_KEY, EDGE, NODE
from .store import GraphStore


def _filled(cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def normalise(tuples: DataFrame, provider: str | None = None) -> DataFrame:
    """Keys trimmed and lower-cased, records hashed, the provider filled in."""
    low = [c for c in (*NODE, *EDGE) if c != "relation_kind"]
    rows = tuples.withColumns({c: F.lower(F.trim(c)) for c in low})
    return rows.withColumns({"provider": F.coalesce("provider", F.lit(provider)), "record_hash": F.md5("record")})


def classify(tuples: DataFrame) -> DataFrame:
    """Each tuple's ``class``: relation (all seven edge fields), detail (node and record), anchor or reject.

    Empty means null here: an empty string is a value.
    """
    kind = F.when(_filled(EDGE), "relation").when(_filled(NODE) & F.col("record").isNotNull(), "detail").when(_filled(NODE), "anchor").otherwise("reject")
    return tuples.withColumn("class", kind)


def first_of_each(rows: DataFrame, key: list[str], order: str = "input_pos") -> DataFrame:
    """The first row of each key in input order."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("v"))
    return first.select(*[F.col(c) if c in key else F.col(f"v.{c}").alias(c) for c in rows.columns])


def absent(batch: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key isn't in ``target``."""
    return batch.join(target.select(*key), key, "left_anti")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names.

    Only a session on this machine alone may do without the setting; elsewhere that is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioweave-"))
    return df.checkpoint()


def mint_serials(rows: DataFrame, start: int, order: list[str]) -> DataFrame:
    """``rows`` with dense serials from ``start`` + 1 on, in ``order``.

    The batch is dealt by ranges and sorted in place; Spark's own ids number each partition's rows in
    their low 33 bits, and the counts of the partitions before shift them.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The counts and the places must see the same deal: it is written once.
    dealt = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    shift, total = [], start
    for own, n in counts:
        shift.append((own, total))
        total += n
    if not shift:
        return dealt.drop("__id").withColumn("serial", F.lit(None).cast("long"))
    shifts = F.broadcast(spark.createDataFrame(shift, "__part long, __shift long"))
    return dealt.join(shifts, part == F.col("__part")).withColumn("serial", F.col("__shift") + place + 1).drop("__id", "__part", "__shift")


class Batch:
    """What one import adds: new rows of each table, and what it left out. Each is planned when it is first asked for."""

    def __init__(self, rows: DataFrame, store: GraphStore) -> None:
        """``rows`` are classified tuples with ``time_sys``."""
        self.rows, self.store = rows, store

    @cached_property
    def _details(self) -> DataFrame:
        own = self.rows.where("class = 'detail'").select(*DETAIL_KEY, "record", "media_type", "time_source", "time_sys", "input_pos")
        return first_of_each(own, DETAIL_KEY)

    @cached_property
    def _relations(self) -> DataFrame:
        return first_of_each(self.rows.where("class = 'relation'").select(*EDGE, "provider", "time_source", "time_sys", "input_pos"), EDGE)

    @cached_property
    def _anchors(self) -> DataFrame:
        """The tuples' own nodes and both ends of their edges, from one pass over the rows."""
        node = lambda end: F.struct(*[F.col(f"{c}{end}").alias(c) for c in NODE])
        nodes = F.when(F.col("class") == "relation", F.array(node("_from"), node("_to"))).otherwise(F.array(node("")))
        return self.rows.where("class <> 'reject'").select(F.explode(nodes).alias("n")).select("n.*").distinct()

    @cached_property
    def anchors(self) -> DataFrame:
        return absent(self._anchors, self.store.anchors, NODE)

    @cached_property
    def details(self) -> DataFrame:
        return absent(self._details, self.store.details, DETAIL_KEY)

    @cached_property
    def relations(self) -> DataFrame:
        return absent(self._relations, self.store.relations, EDGE)

    @cached_property
    def rejects(self) -> DataFrame:
        return self.rows.where("class = 'reject'")

    @cached_property
    def report(self) -> DataFrame:
        """A row for each class and kind: total in the batch after dedup, and affected, that is new."""
        lines = None
        for name, all_rows, fresh in (("anchor", self._anchors, self.anchors), ("detail", self._details, self.details), ("relation", self._relations, self.relations)):
            own = F.col("kind") if name != "relation" else F.concat_ws("__", "kind_from", "kind_to")
            total = all_rows.groupBy(own.alias("kind")).agg(F.count("*").alias("total"))
            new = fresh.groupBy(own.alias("kind")).agg(F.count("*").alias("affected"))
            line = total.join(new, "kind", "left").select(F.lit(name).alias("class"), "kind", "total", F.coalesce("affected", F.lit(0)).alias("affected"))
            lines = line if lines is None else lines.unionByName(line)
        return lines


def prepare(tuples: DataFrame, store: GraphStore, provider: str | None = None, now=None) -> Batch:
    """Classify and dedup ``tuples`` and keep what ``store`` lacks; nothing is written.

    Relations bring both of their ends as anchors, details their own.
    """
    rows = classify(normalise(tuples, provider))
    stamp = F.lit(now).cast("timestamp_ntz") if now is not None else F.localtimestamp()
    return Batch(rows.withColumn("time_sys", stamp), store)


#: The key in whose order each table's serials are minted.
_ORDER = {"anchors": NODE, "details": DETAIL_KEY, "relations": EDGE}


def minted(batch: Batch, store: GraphStore, name: str, most: int | None = None) -> DataFrame:
    """A batch's rows to append to one of ``store``'s tables, with serials that follow its largest, or ``most``."""
    old, new = getattr(store, name), getattr(batch, name)
    if most is None:
        most = old.agg(F.max("serial").alias("m")).first()["m"] or 0
    return mint_serials(new.drop("input_pos"), most, _ORDER[name]).select(*old.columns)


def upsert(tuples: DataFrame, store: GraphStore, provider: str | None = None, now=None, largest: dict[str, int] | None = None) -> GraphStore:
    """The rows to append to each table of ``store``, with serials; appending them is the import.

    Serials follow the store's largest, or those of ``largest`` by table, where rows that were deleted had larger ones.
    """
    batch = prepare(tuples, store, provider, now)
    return GraphStore(*[minted(batch, store, name, (largest or {}).get(name)) for name in _ORDER])


def appended(store: GraphStore, new: GraphStore) -> GraphStore:
    return GraphStore(store.anchors.unionByName(new.anchors), store.details.unionByName(new.details), store.relations.unionByName(new.relations))


def new_codes(batch: DataFrame, column: str, dimension: DataFrame, code: str = "code") -> DataFrame:
    """Codes (sources, providers) of a batch that a dimension lacks, once each."""
    own = batch.select(F.col(column).alias(code)).dropna().distinct()
    return own.join(dimension.select(code), code, "left_anti")


def matching(kind: str, source: str | None = None, key: str | None = None, end: str = "") -> Column:
    """Whether a row is of the kind, source or node; of edges one ``end``, ``_from`` or ``_to``."""
    cond = F.col(f"kind{end}") == kind
    for name, value in (("source", source), ("key", key)):
        cond = cond if value is None else cond & (F.col(f"{name}{end}") == value)
    return F.coalesce(cond, F.lit(False))


def removal(store: GraphStore, kind: str, source: str | None = None, key: str | None = None) -> GraphStore:
    """What a cascading delete takes from ``store``: a kind's, source's or node's anchors, details and edges either way, each once."""
    own, edges = matching(kind, source, key), matching(kind, source, key, "_from") | matching(kind, source, key, "_to")
    return GraphStore(store.anchors.where(own), store.details.where(own), store.relations.where(edges))


def cascade(store: GraphStore, kind: str, source: str | None = None, key: str | None = None) -> tuple[GraphStore, DataFrame]:
    """``store`` without a kind's, source's or node's anchors, details and edges, and the counts removed."""
    own, into, out = (matching(kind, source, key, end) for end in ("", "_to", "_from"))
    steps = [
        ("incoming", store.relations.where(into)), ("outgoing", store.relations.where(out & ~into)),
        ("details", store.details.where(own)), ("anchors", store.anchors.where(own)),
    ]
    counts = None
    for name, rows in steps:
        line = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
        counts = line if counts is None else counts.unionByName(line)
    return GraphStore(store.anchors.where(~own), store.details.where(~own), store.relations.where(~into & ~out)), counts
