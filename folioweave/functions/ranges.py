"""Lists of page ranges such as ``1-5,7,-2``, and gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may stand between two numbers, and whether the second one belongs to the range.
SEPARATORS = {"-": True, "..": True, "‥": True, "...": False, "…": False, "⋯": False}
_NUMBER = r"(?<![0-9])-?[0-9]+"


def _part_numbers(part: Column) -> Column:
    """The numbers of one part of a list: those it names, and for two with a separator all between them."""
    named = F.transform(F.regexp_extract_all(part, F.lit(_NUMBER), F.lit(0)), lambda n: n.try_cast("long"))
    between = F.regexp_replace(part, _NUMBER, "")
    closed = F.try_element_at(F.create_map(*[F.lit(x) for pair in SEPARATORS.items() for x in pair]), between)
    low, high = F.get(named, F.lit(0)), F.get(named, F.lit(1))
    every = F.filter(F.sequence(low, high), lambda n: closed | (n != high))
    single = (F.size(named) == 1) & (between == "")
    return F.when(single, named).when((F.size(named) == 2) & closed.isNotNull(), every).otherwise(F.array().cast("array<bigint>"))


def range_numbers(text: Column, most: int | None = None) -> Column:
    """The sorted distinct numbers of a list; ``a-b`` and ``a..b`` with, ``a...b`` without its end.

    Negative numbers count from ``most`` back and are dropped without it; so are numbers above it. An
    empty list is all of 1 to ``most``.
    """
    found = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), ","), _part_numbers))
    if most:
        found = F.transform(found, lambda n: F.when(n < 0, n + (most + 1)).otherwise(n))
    top = F.lit(most).cast("long") if most else F.lit(None).cast("long")
    kept = F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 0) & (top.isNull() | (n <= top)))))
    return F.when(top.isNotNull() & (F.size(kept) == 0), F.sequence(F.lit(1).cast("long"), top)).otherwise(kept) if most else kept


def runs(numbers: Column, longest: int | None = None) -> Column:
    """An array of structs (from, to): runs of neighbouring numbers, of at most ``longest`` each."""
    empty = F.array().cast("array<struct<from:bigint,to:bigint>>")

    def step(done: Column, n: Column) -> Column:
        last = F.element_at(done, -1)
        full = (last["to"] - last["from"] + 1 >= longest) if longest else F.lit(False)
        fresh = F.concat(done, F.array(F.struct(n.alias("from"), n.alias("to"))))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["from"].alias("from"), n.alias("to"))))
        return F.when(F.size(done) == 0, fresh).when((n - last["to"] > 1) | full, fresh).otherwise(grown)

    return F.aggregate(numbers, empty, step)


def islands(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """Runs of neighbouring numbers per group, over rows instead of an array; a group's nulls are a run of one.

    One sort by group and number, in which a run's first and last row tell by their neighbours: nothing is hashed, and repeats need no pass of their own.
    """
    order = Window.partitionBy(*by).orderBy("n")
    n, before, behind = F.col("n"), F.col("before"), F.col("behind")
    own = rows.select(*by, F.col(number).cast("long").alias("n"))
    own = own.withColumns({"before": F.lag("n").over(order), "behind": F.lead("n").over(order), "at": F.row_number().over(order)})
    first, last = before.isNull() | (n - before > 1), behind.isNull() | (behind - n > 1)
    # Nulls come first in order.
    kept = own.select(*by, "n", first.alias("first"), F.when(n.isNull(), F.col("at") == 1).otherwise(last).alias("last")).where(F.col("last") | (n.isNotNull() & F.col("first")))
    began = kept.withColumn("from", F.when(F.col("first"), n).otherwise(F.lag("n").over(order))).where("last")
    return began.select(*by, "from", n.alias("to"), F.coalesce(n - F.col("from") + 1, F.lit(1).cast("long")).alias("size"))
