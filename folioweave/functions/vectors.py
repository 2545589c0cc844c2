"""Dense vectors: norms, sums of unit vectors, nearest by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2norm(v: Column) -> Column:
    """Euclidean length, scaled by the largest component so that squares don't overflow."""

    def scaled(top: Column) -> Column:
        squares = F.transform(v, lambda x: (x.cast("double") / top) * (x.cast("double") / top))
        return F.when((F.size(v) == 0) | (top == 0), 0.0).otherwise(top * F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))

    # Bound once: in a lambda it would be worked out for every component.
    return let(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), scaled)


def unit_sum(vectors: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Per group the sum of the unit vectors, made a unit vector again; zero vectors add nothing."""
    unit = let(l2norm(F.col(vector)), lambda n: F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)))
    each = vectors.select(*by, F.posexplode(unit).alias("i", "x"))
    total = each.groupBy(*by, "i").agg(F.sum("x").alias("x"))
    packed = total.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"))
    return packed.select(*by, let(l2norm(F.col("s")), lambda size: F.transform("s", lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0)))).alias("vector"))


def nearest(vectors: DataFrame, query: list[float], limit: int = 100, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``limit`` vectors of the greatest cosine with ``query``, 1000 at most, with rank and distance."""
    q = F.array(*[F.lit(float(x)) for x in query])
    # A zero vector has no direction: null, and not among the nearest.
    cosine = F.try_divide(dot(F.col(vector), q), l2norm(F.col(vector)) * l2norm(q))
    scored = vectors.select(id_col, (1 - cosine).alias("distance")).where(F.col("distance").isNotNull())
    top = scored.orderBy("distance", id_col).limit(min(1000, max(1, limit)))
    # Ranks are given to the page of at most 1000 rows only.
    rows = top.agg(F.array_sort(F.collect_list(F.struct("distance", id_col))).alias("p"))
    return rows.select(F.posexplode("p").alias("rank", "p")).select(F.col(f"p.{id_col}").alias(id_col), "rank", "p.distance")
