"""Approximate nearest vectors: inverted lists of trained centroids, few of them searched, distances exact.

A search deals the vectors to parts and the queries to blocks, both of bounded size. A part and a block that meet are
compared list by list as products of matrices, and of each query the best are kept; the parts' best are then ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.vectors import l2norm

#: Lists of an index, lists that a search looks into, and vectors that the centroids are trained on, at most.
LISTS, PROBES, SAMPLE = 256, 24, 200_000
#: Components that a part of the vectors and a block of the queries have at most, similarities that are looked at together, and vectors times lists of a task that deals vectors to lists.
PART, BLOCK, TOGETHER, DEALT = 2**21, 2**20, 2**21, 5 * 10**7


def _tasks(rows: DataFrame, work: int) -> DataFrame:
    """The rows dealt evenly to tasks of at most ``DEALT`` of the work, three a core at least."""
    return rows.repartition(max(3 * rows.sparkSession.sparkContext.defaultParallelism, -(-work // DEALT)))


def _unit(vector: Column) -> Column:
    """The vector at length one; null for a vector without a direction, or with a component that is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, let(l2norm(vector), lambda n: F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n))))


def _directed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """The key and the vector at length one of those that have a direction."""
    # A filter would be worked out before the rows are dealt.
    return rows.select(key, F.explode(F.array_compact(F.array(_unit(F.col(vector))))).alias(vector))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if len(column) and pc.any(pc.not_equal(pc.list_value_length(column), width)).as_py():
        raise ValueError(f"vectors and queries must have one length, {width}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _few_copies(v: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The rows that fewer than ``most`` equal ones precede by ``order``. Others are as far from any query as those before them, and so never among its best."""
    _, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    by = np.lexsort((order, same))
    same = same[by]
    return np.sort(by[np.arange(len(by)) - np.searchsorted(same, same) < most])


def _best(v: np.ndarray, lists: np.ndarray, order: np.ndarray, q: np.ndarray, row: np.ndarray, asked: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``most`` vectors of the least distance, ties by ``order``: rows of ``q``, rows of ``v`` and distances.

    ``lists`` has the vectors' lists; the query ``row[n]`` looks into the list ``asked[n]``. Products of matrices find who may be among the best,
    whatever their rounding; the distances of these are then added up component by component, as ``1 - dot(v, q)`` is.
    """
    slack = 8 * v.shape[1] * np.finfo(float).eps
    top, least = np.full((len(q), most), -np.inf), np.full(len(q), -np.inf)

    def trimmed(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
        may = s >= least[i] - slack
        i, j, s = i[may], j[may], s[may]
        total = np.zeros(len(i))
        for k in range(v.shape[1]):
            total += v[j, k] * q[i, k]
        by = np.lexsort((order[j], 1 - total, i))
        i = i[by]
        first = np.arange(len(i)) - np.searchsorted(i, i) < most
        by = by[first]
        return i[first], j[by], s[by], 1 - total[by]

    none = np.zeros(0, np.int64)
    found, held = [(none, none, np.zeros(0))], 0
    by_list, by_asked = np.argsort(lists, kind="stable"), np.argsort(asked, kind="stable")
    for number in np.intersect1d(lists, asked):
        own = by_list[slice(*np.searchsorted(lists[by_list], [number, number + 1]))]
        own = own[_few_copies(v[own], order[own], most)]
        who = row[by_asked[slice(*np.searchsorted(asked[by_asked], [number, number + 1]))]]
        step = max(1, TOGETHER // len(own))
        for at in range(0, len(who), step):
            i = who[at : at + step]
            s = q[i] @ v[own].T
            better = s.max(axis=1) >= least[i] - slack
            i, s = i[better], s[better]
            top[i] = np.partition(np.concatenate([top[i], s], axis=1), -most, axis=1)[:, -most:]
            least[i] = top[i].min(axis=1)
            a, b = np.nonzero(s >= least[i][:, None] - slack)
            found.append((i[a], own[b], s[a, b]))
            held += len(a)
            if held > TOGETHER + 2 * len(q) * most:
                found = [trimmed(*map(np.concatenate, zip(*found)))[:3]]
                held = len(found[0][0])
    i, j, _, distance = trimmed(*map(np.concatenate, zip(*found)))
    return i, j, distance


def _compared(vectors: DataFrame, asked: DataFrame, width: int, most: int, parts: int, blocks: int) -> DataFrame:
    """Rows (query, id, rank, distance) of vectors (id, v, list, part) and queries (query, q, lists, part), of so many parts and dealt to so many blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        ids, queries, wanted = (t.column(c).combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type) for t, c in ((left, "id"), (right, "query"), (right, "lists")))
        i = j = np.zeros(0, np.int64)
        distance = np.zeros(0)
        if len(ids) and len(queries):
            v, q = _matrix(left.column("v").combine_chunks(), width), _matrix(right.column("q").combine_chunks(), width)
            order = np.empty(len(ids), np.int64)
            order[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            row = np.repeat(np.arange(len(queries)), pc.list_value_length(wanted).to_numpy())
            i, j, distance = _best(v, left.column("list").to_numpy(), order, q, row, wanted.flatten().to_numpy(), most)
        return pa.table({"query": queries.take(pa.array(i)), "id": ids.take(pa.array(j)), "distance": pa.array(distance, pa.float64())})

    every = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query", "q"), F.lit(blocks)).cast("int"))
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double"
    # The session's number of shuffle partitions doesn't grow with that of the cells.
    tasks = max(3 * vectors.sparkSession.sparkContext.defaultParallelism, 2 * parts * blocks)
    every, dealt = (rows.repartition(tasks, "part", "block").groupBy("part", "block") for rows in (every, dealt))
    found = every.cogroup(dealt).applyInArrow(run, kinds)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= most)
    return ranked.select("query", "id", (F.col("rank") - 1).alias("rank"), "distance")


@dataclass(frozen=True)
class VectorIndex:
    """An index below ``path``: ``lists``, partitioned by the number of the list, and ``centroids``."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding", lists: int = LISTS, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """Train ``lists`` centroids on about ``sample`` vectors, at most 2 ** 31, and write every vector to the list of its nearest one.

        Vectors without a direction are nobody's neighbours and left out. All others must have one length. A list of
        very many vectors is written by several tasks.
        """
        # Only here, as the import is large.
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        given = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
        rows = _directed(_tasks(given, given.count() * lists), "id", "v")
        share = min(1.0, sample / max(1, rows.count()))
        some = rows.where(F.xxhash64("v", F.lit(seed)) <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))) if share < 1 else rows
        features = lambda df: df.withColumn("features", array_to_vector("v"))
        model = KMeans(k=max(2, lists), seed=seed, maxIter=15, predictionCol="list").fit(features(some))
        own = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
        spark.createDataFrame(own, "list int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        model.transform(features(rows)).select("id", "v", "list").hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
        return VectorIndex(spark, path)

    def search(self, queries: DataFrame, limit: int = 100, probes: int = PROBES, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """Of each query the ``limit`` vectors of the greatest cosine, 1000 at most, among the ``probes`` lists nearest to it.

        Rows (query, id, rank, distance), ranks from 0; ties by id. Distances are exact. Queries have the vectors' length; those without a direction find nothing, those of equal id count
        as one with the vectors of all. Partitions of lists that no query looks into aren't read.
        """
        centroids = np.array([r["c"] for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()])  # one row a list
        most, probes, width = min(1000, max(1, limit)), min(len(centroids), max(1, probes)), centroids.shape[1]
        stored = self.spark.read.parquet(f"{self.path}/lists")
        parts = self._parts({r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}, max(1, PART // width))
        own = queries.select(F.col(id_col).alias("query"), F.col(vector).alias("q"))
        number = own.count()
        asked = self._asked(_directed(_tasks(own, number * len(centroids)), "query", "q"), centroids, parts, probes)
        if probes < len(centroids):
            stored = stored.where(F.col("list").isin([r["list"] for r in asked.select(F.explode("lists").alias("list")).distinct().collect()]))
        places = self.spark.createDataFrame(list(parts.items()), "list int, parts array<int>")
        # A list of several parts deals its rows to them by their place in the file.
        placed = stored.withColumn("at", F.col("_metadata.row_index")).join(F.broadcast(places), "list")
        rows = placed.select("id", "v", "list", F.get("parts", F.pmod("at", F.size("parts")).cast("int")).alias("part"))
        blocks = max(1, -(-number // max(1, min(BLOCK // width, TOGETHER // most))))
        return _compared(rows, asked, width, most, len({part for own_parts in parts.values() for part in own_parts}), blocks)

    @staticmethod
    def _parts(sizes: dict[int, int], largest: int) -> dict[int, list[int]]:
        """The parts of about ``largest`` vectors that each list's vectors are dealt to: small lists share one, a large one has several."""
        parts, part, held = {}, 0, 0.0
        for number, n in sorted(sizes.items()):
            pieces = -(-n // largest)
            parts[number] = []
            for _ in range(pieces):
                if held and held + n / pieces > largest:
                    part, held = part + 1, 0.0
                parts[number].append(part)
                held += n / pieces
        return parts

    @staticmethod
    def _asked(own: DataFrame, centroids: np.ndarray, parts: dict[int, list[int]], probes: int) -> DataFrame:
        """Rows (query, q, lists, part): for each part with some of the ``probes`` lists nearest to the query these lists."""
        within: dict[int, list[int]] = {}
        for number, own_parts in parts.items():
            for part in own_parts:
                within.setdefault(part, []).append(number)
        size, step, width = (centroids * centroids).sum(axis=1), max(1, TOGETHER // len(centroids)), centroids.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    # |q - c|^2 without |q|^2, which is the same for all centroids.
                    far = size - 2 * (_matrix(batch.column("q"), width) @ centroids.T)
                    near = np.zeros(far.shape, bool)
                    np.put_along_axis(near, np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
                    for part, numbers in within.items():
                        i, k = np.nonzero(near[:, numbers])
                        rows, n = np.unique(i, return_counts=True)
                        if len(rows):
                            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.array(numbers)[k], pa.int32()))
                            columns = [batch.column("query").take(pa.array(rows)), batch.column("q").take(pa.array(rows)), lists, pa.array([part] * len(rows), pa.int32())]
                            yield pa.RecordBatch.from_arrays(columns, names=["query", "q", "lists", "part"])

        return own.mapInArrow(run, f"query {own.schema['query'].dataType.simpleString()}, q array<double>, lists array<int>, part int")


def exact_neighbours(vectors: DataFrame, queries: DataFrame, limit: int = 100, id_col: str = "vec_id", vector: str = "embedding", block: int = 1000) -> DataFrame:
    """What ``VectorIndex.search`` finds if it looks into all lists, by comparing every query with every vector.

    The queries are a stated set, dealt to blocks of about ``block``, each of which meets every part of the vectors.
    """
    most = min(1000, max(1, limit))
    rows = vectors.select(F.col(id_col).alias("id"), _unit(F.col(vector)).alias("v")).where("v IS NOT NULL")
    own = queries.select(F.col(id_col).alias("query"), _unit(F.col(vector)).alias("q")).where("q IS NOT NULL")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    parts = max(1, -(-n // max(1, PART // width)))
    dealt = rows.select("id", "v", F.lit(0).alias("list"), F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("part"))
    asked = own.select("query", "q", F.array(F.lit(0)).alias("lists"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return _compared(dealt, asked, width, most, parts, max(1, -(-own.count() // block)))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of the exact neighbours that were found: one row (queries, neighbours, recall)."""
    hit = exact.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("neighbours"), (F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("recall"))
