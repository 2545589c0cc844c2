"""Centroid clustering of integer vectors by sort-means, exact to the last tie.

In each round the other centroids are ordered by their distance from each centroid. A vector begins at the centroid
that it was assigned to before and tries the others in that centroid's order; from the first one that lies strictly
more than twice as far from it as the vector does, none can be nearer or as near, so the scan stops. Vectors stay
where they are: a round is one pass over them, and only sums of clusters are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

CENTROIDS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: The largest component up to which a difference's square, summed over many components, fits in 64 bits.
FITS = 1 << 26
LONGEST = 2**63 - 1


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` from the vector ``y``."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart) if apart.dtype != object else (apart * apart).sum(axis=1)


def assign(vectors: np.ndarray, centroids: list[list[int]], previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance from the nearest centroid, the smaller number on ties, for each row of ``vectors``.

    ``previous`` has the centroid that each row's scan begins at. Where components are too large for sums in 64
    bits, numbers of any size are used.
    """
    # The least long has no absolute value, so both ends are looked at.
    wide = max((abs(c) for row in centroids for c in row), default=0) > FITS or (vectors.size and (int(vectors.max()) > FITS or int(vectors.min()) < -FITS))
    kind = object if wide or vectors.shape[1] > 512 else np.int64
    x, c = vectors.astype(kind), np.array(centroids, dtype=kind)
    nearest, least = previous.astype(np.int64), np.zeros(len(x), kind)
    for home in np.unique(previous).tolist():
        rows = np.flatnonzero(previous == home)
        gap = _squared(c, c[home])
        own = _squared(x[rows], c[home])
        best, who = own.copy(), np.full(len(rows), home)
        live = np.arange(len(rows))
        for other in sorted((k for k in range(len(c)) if k != home), key=lambda k: (gap[k], k)):
            live = live[gap[other] <= 4 * own[live]]
            if not len(live):
                break
            d = _squared(x[rows[live]], c[other])
            nearer = (d < best[live]) | ((d == best[live]) & (other < who[live]))
            best[live[nearer]], who[live[nearer]] = d[nearer], other
        nearest[rows], least[rows] = who, best
    return nearest, least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def kept(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """Rows (id, v) of the vectors of ``width`` finite components, each turned into floor(scale * component)."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = lambda x: F.floor(scale * x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where((F.size("x") == width) & F.forall("x", sound)).select("id", F.transform("x", whole).alias("v"))


def _moved(state: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    """The rows (id, v, cluster) assigned anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, _ = assign(_matrix(batch.column(1), width), centroids, batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32())], names=["id", "v", "cluster"])

    return state.mapInArrow(run, state.schema)


def _placed(state: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    """Rows (id, cluster, distance); a distance beyond the largest long is that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = assign(_matrix(batch.column(1), width), centroids, batch.column(2).to_numpy())
                distance = distance if distance.dtype == np.int64 else np.array([min(d, LONGEST) for d in distance], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    return state.mapInArrow(run, f"id {state.schema['id'].dataType.simpleString()}, cluster int, distance long")


def _updated(state: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The componentwise floors of the clusters' means; empty clusters keep their centroid.

    Tasks sum up what they hold; what comes to the driver is a row for each centroid and component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), object)
        for batch in batches:
            x, cluster = _matrix(batch.column(0), width), batch.column(1).to_numpy()
            for k in np.unique(cluster).tolist():
                own = x[cluster == k]
                # Halves of 32 bits add up without overflow.
                total[k] += (own >> 32).sum(axis=0).astype(object) * (1 << 32) + (own & 0xFFFFFFFF).sum(axis=0).astype(object)
                count[k] += len(own)
        for k in np.flatnonzero(count).tolist():
            columns = [pa.array([k] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([str(t) for t in total[k]]), pa.array([int(count[k])] * width)]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "at", "total", "n"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, at int, total string, n long")
    sums = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = [list(c) for c in centroids]
    for row in sums.collect():
        out[row["cluster"]][row["at"]] = int(row["total"]) // row["n"]
    return out


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = 1
) -> tuple[DataFrame, list[list[int]]]:
    """Rows (id, cluster, distance), one for each vector kept, and the final centroids.

    Vectors of exactly ``width`` components, none null or not finite, are kept; a component x becomes the integer
    floor(scale * x), or the nearest long if it is beyond one. The centroids start as the ``centroids`` vectors with
    the smallest SHA-256 of ``seed:id`` in that order (equal hashes: by components; a null id counts as empty). Each of
    ``rounds`` rounds assigns every vector to the nearest centroid by squared distance, the smaller number on ties, and moves each centroid
    that has vectors to the floors of their mean; then vectors are assigned once more. ``distance`` is
    squared, and the largest long where it is beyond that.

    Ids may be null or repeat, each row counts. With fewer vectors than ``centroids`` each begins as one; with none
    the result is empty. Other columns are neither read nor returned. Vectors and their clusters are checkpointed
    once a round, as the next round begins from them.
    """
    base = kept(vectors, id_col, vector_col, width, scale)
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = [list(r["v"]) for r in base.select(h.alias("h"), "v").orderBy("h", "v").limit(centroids).collect()]
    state = base.withColumn("cluster", F.lit(0))
    for _ in range(rounds if chosen else 0):
        state = cut(_moved(state, chosen, width))
        chosen = _updated(state, chosen, width)
    if not chosen:
        state = state.limit(0)
    return _placed(state, chosen, width).withColumnRenamed("id", id_col), chosen


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The rows of ``cluster_vectors`` with the sums of distances of their cluster and of all, and their centroid's SHA-256."""
    found = cut(found)
    of = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # a row a centroid
    everything = sum(int(r["inertia"]) for r in of)
    rows = [(r["cluster"], min(int(r["inertia"]), LONGEST), min(everything, LONGEST), ",".join(map(str, centroids[r["cluster"]]))) for r in of]
    told = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, words string")
    return found.join(F.broadcast(told), "cluster").select(*(c for c in found.columns), "cluster_inertia", "inertia", F.sha2("words", 256).alias("centroid_sha256"))


def _oracle() -> str:
    """The query's result in SQL, a few expressions a round."""
    parts = [
        "kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "v AS (SELECT vec_id, unnest(range(64)) AS place, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM kept)",
        "seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < 16)",
        "c0 AS (SELECT cluster, place, x FROM v JOIN seeds USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"""a{k} AS (SELECT vec_id, cluster, distance FROM (SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{k} c USING (place) GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if k < ROUNDS:
            parts.append(f"""c{k + 1} AS (SELECT c.cluster, c.place, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN
                (SELECT cluster, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM v JOIN a{k} USING (vec_id) GROUP BY ALL) m USING (cluster, place))""")
    last = f"""SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{ROUNDS} JOIN (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster) USING (cluster)"""
    return "WITH " + ",\n".join(parts) + "\n" + last


ORACLE = _oracle()
