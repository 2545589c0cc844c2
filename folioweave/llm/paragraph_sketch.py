"""Document fingerprints as invertible Bloom lookup sketches; DataFrame functions only.

A text's paragraphs, runs of up to ``GROUP`` sentences within a line, are digested to 64 bits. The
sketch has ``CELLS`` cells, in three parts; each digest is added to one cell of each part: the cell
keeps the number of its digests and the XOR of the digests and of their check sums. Subtracting
two sketches cell by cell leaves the digests that only one of the texts has; cells that hold just
one of them are recognised by their check sum, and taking it off all its cells frees others, until
nothing is left. Where that fails, the sketch is made larger: the digests are dealt by another hash
to as many sketches as they may fill, which are subtracted and peeled anew, and again until all peel.

Sketches, differences and peeling are expressions over one row's arrays, so texts are shuffled once,
to meet their next text, and afterwards only the digests of the texts whose sketch was too small.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_bound, xor_key

GROUP = 3
PART = 8
CELLS = 3 * PART
ROUNDS = 8
#: Digests that a retry deals to one sketch, at most and on average.
LOAD = 12
_PARAGRAPH = rf"(?:[^.!?\n]*+[.!?]++){{1,{GROUP}}}|[^.!?\n]++"
_CELLS_TYPE = "array<struct<n:int,k:bigint,x:bigint>>"
#: A row's band and its place there.
KEY = ["band", "place"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used inside of lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text; none of a null or blank-line text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(7))


def _bit(mask: Column, i: Column) -> Column:
    return F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1


def _cells_of(key: Column, level: int) -> Column:
    """A mask of the digest's cells, one bit in each of the three parts."""

    def mask(h: Column) -> Column:
        one = lambda k: F.call_function("shiftleft", F.lit(1), F.lit(PART * k) + F.pmod(F.shiftrightunsigned(h, 20 * k).bitwiseAND(F.lit(0xFFFFF)), F.lit(PART)).cast("int"))
        return one(0).bitwiseOR(one(1)).bitwiseOR(one(2))

    return _let(F.xxhash64(key, F.lit(100 + level)), mask)


def _xor(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, p: a.bitwiseXOR(p[field]))


def sketch(keys: Column, level: int = 0) -> Column:
    """The cells of an array of digests."""

    def cells(marked: Column) -> Column:
        cell = lambda own: F.struct(F.size(own).alias("n"), _xor(own, "k").alias("k"), _xor(own, "x").alias("x"))
        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: _let(F.filter(marked, lambda p: _bit(p["m"], i)), cell))

    marked = F.transform(keys, lambda d: F.struct(d.alias("k"), _check(d).alias("x"), _cells_of(d, level).alias("m")))
    return _let(marked, cells).cast(_CELLS_TYPE)


def minus(a: Column, b: Column) -> Column:
    """The difference of two sketches, cell by cell."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["x"].bitwiseXOR(y["x"]).alias("x")))


def peel(cells: Column, level: int = 0) -> Column:
    """Struct (found, whole): the digests that peeling a difference takes off, and whether none is left."""

    def step(state: Column, _: Column) -> Column:
        seen = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["k"]) == c["x"]))
        pure = F.transform(F.array_distinct(seen), lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"), c["x"].alias("x"), _cells_of(c["k"], level).alias("m")))

        def less(c: Column, hit: Column) -> Column:
            n = F.aggregate(hit, F.lit(0), lambda a, p: a + p["n"])
            return F.struct((c["n"] - n).alias("n"), c["k"].bitwiseXOR(_xor(hit, "k")).alias("k"), c["x"].bitwiseXOR(_xor(hit, "x")).alias("x"))

        def taken(ps: Column) -> Column:
            left = F.transform(state["cells"], lambda c, i: _let(F.filter(ps, lambda p: _bit(p["m"], i)), lambda hit: F.when(F.size(hit) == 0, c).otherwise(less(c, hit))))
            return F.when(F.size(ps) == 0, state).otherwise(F.struct(left.alias("cells"), (state["found"] + F.size(ps)).alias("found")))

        return _let(pure, taken)

    empty = lambda cs: F.forall(cs, lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["x"] == 0))
    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return _let(end, lambda s: F.struct(s["found"].cast("long").alias("found"), empty(s["cells"]).alias("whole")))


def written(cells: Column) -> Column:
    """A sketch as text: per cell the number, the digests and the check sums in hexadecimal."""
    word = lambda x, n: F.lpad(F.hex(x), n, "0")
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(word(c["n"], 2), word(c["k"], 16), word(c["x"], 16))), "."))


def _banded(own: DataFrame) -> DataFrame:
    """``own`` with ``band``: runs of rows by descending id and text hash, as many as there are shuffle partitions; null ids last.

    An id that many rows have, and null, is split by the text hash into as many bands as its share of the rows. A row's
    band is found in two steps, among the runs' first bounds and then within one run of bounds.
    """
    spark = own.sparkSession
    bands = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = own.schema["id"].dataType.simpleString()
    # One bound a band comes to the driver, of ids that are strings a sample of about 50 a band.
    of = own.agg(F.count("*").alias("rows"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    if kind == "string":
        share = min(1.0, 50 * bands / max(1, of["rows"]))
        some = sorted(r["id"] for r in own.where(F.col("id").isNotNull() & (F.xxhash64("id", "th", F.lit("band")) <= hash_bound(share))).select("id").limit(500 * bands).collect())
        found = [some[k * len(some) // bands] for k in range(1, bands)] if some else []
    else:
        found = own.agg(F.approx_percentile("id", [k / bands for k in range(1, bands)], max(10_000, 10 * bands)).alias("q")).first()["q"] or []
    least, wide = -(1 << 63), 1 << 64
    bounds = sorted(((i, least + wide * k // found.count(i)) for i in set(found) for k in range(found.count(i))), reverse=True)
    of_nulls = max(1, round(bands * of["nulls"] / max(1, of["rows"])))
    ends = [least + wide * k // of_nulls for k in range(of_nulls - 1, 0, -1)]
    null_band = F.lit(len(bounds) + 1) + F.size(F.filter(F.from_json(F.lit(json.dumps(ends)), "array<bigint>"), lambda b: b > F.col("th")))
    if not bounds:
        return own.withColumn("band", F.when(F.col("id").isNull(), null_band).otherwise(0).cast("int"))
    width = max(1, int(len(bounds) ** 0.5))
    groups = [[{"i": i, "t": t} for i, t in bounds[k : k + width]] for k in range(0, len(bounds), width)]
    # Read as constants when the plan is made: one literal each, however many bands there are.
    shape = f"struct<i:{kind},t:bigint>"
    heads, runs = F.from_json(F.lit(json.dumps([g[0] for g in groups])), f"array<{shape}>"), F.from_json(F.lit(json.dumps(groups)), f"array<array<{shape}>>")
    above = lambda xs: F.size(F.filter(xs, lambda b: (b["i"] > F.col("id")) | ((b["i"] == F.col("id")) & (b["t"] > F.col("th")))))
    at = F.greatest(above(heads), F.lit(1))
    band = _let(at, lambda k: (k - 1) * width + above(F.element_at(runs, k)))
    return own.withColumn("band", F.when(F.col("id").isNull(), null_band).otherwise(band).cast("int"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (band, place, id, text, d0, next, d2): each text and its digests beside those of the next row.

    Ids are numbers or strings. The order is descending id (null ids last), then descending text hash; the first row follows the
    last. Rows of equal id and text follow each other. Each band is sorted on its own, with a copy of
    the first row of the next band behind its last; text and digests of the next row come by the same sort.
    """
    spark = docs.sparkSession
    own = _banded(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), xor_key(F.col(text_col)).alias("th")))
    # One row a band.
    heads = sorted((r["band"], r["head"]["id"], r["head"]["th"]) for r in own.groupBy("band").agg(F.max(F.struct("id", "th")).alias("head")).collect())
    shape = f"nid {docs.schema[id_col].dataType.simpleString()}, nth long, before int"
    follow = [(heads[(k + 1) % len(heads)][1], heads[(k + 1) % len(heads)][2], heads[k][0]) for k in range(len(heads))]
    heads_of = F.broadcast(spark.createDataFrame(follow, shape))
    copies = own.join(heads_of, F.col("id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth"))).groupBy("id", "th", "before").agg(F.first("text").alias("text"))
    copies = copies.select("id", "text", "th", F.col("before").alias("band"), F.lit(True).alias("copy"))
    order = Window.partitionBy("band").orderBy("copy", F.col("id").desc_nulls_last(), F.col("th").desc())
    both = own.select("id", "text", "th", "band", F.lit(False).alias("copy")).unionByName(copies)
    # One partition a band: hashed bands would meet by chance, and the more of them the larger the most.
    both = both.repartitionById(heads[-1][0] + 1, "band") if heads else both
    seen = both.withColumns({"next": F.lead("text").over(order), "place": F.row_number().over(order), "d0": digests(F.col("text"))}).withColumn("d2", F.lead("d0").over(order))
    return seen.where(~F.col("copy")).select(*KEY, "id", "text", "d0", "next", "d2")


def _retry(items: DataFrame, level: int) -> DataFrame:
    """Items (key, of, path, a, b) whose sketch was too small, dealt to more sketches and peeled.

    The arrays of digests of both texts stay with parts that don't peel yet.
    """
    parts = F.greatest(F.ceil((F.size("a") + F.size("b")) / LOAD), F.lit(2))
    sides = F.concat(F.transform("a", lambda k: F.struct(F.lit(0).alias("side"), k.alias("key"))), F.transform("b", lambda k: F.struct(F.lit(1).alias("side"), k.alias("key"))))
    each = items.select(*KEY, "of", "path", parts.alias("parts"), F.explode(sides).alias("s")).select(*KEY, "of", "path", "parts", "s.*")
    part = F.pmod(F.xxhash64("key", F.lit(1000 + level)), F.col("parts"))
    side = lambda k: F.collect_list(F.when(F.col("side") == k, F.col("key")))
    dealt = each.groupBy(*KEY, "of", F.xxhash64("path", part).alias("path")).agg(side(0).alias("a"), side(1).alias("b"))
    judged = dealt.withColumn("r", peel(minus(sketch(F.col("a"), level), sketch(F.col("b"), level)), level))
    rest = lambda c: F.when(~F.col("r.whole"), F.col(c)).alias(c)
    return judged.select(*KEY, "of", "path", "r", rest("a"), rest("b"))


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited version and their likeness.

    One row (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_paragraphs, differing) for each row. The edited text is the text with its last third replaced
    by the beginning of the next text (see ``with_next``). Likeness is 1 less the share of the
    digests of both texts that only one of them has, 1 for two texts without any. ``differing`` is
    how many digests peeling recovered between text and edited text.

    A null text is an empty one. Rows with equal id and text follow each other, and each is told. Null ids are ids; they are
    told as null. Ids are numbers or strings. Other columns aren't read, whatever they are called. An
    empty table gives an empty result.
    """
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next"), F.lit(1), tail))
    rows = with_next(docs, id_col, text_col).select(*KEY, "id", n.cast("long").alias("n_chars"), edited.alias("edited"), "d0", "d2")
    rows = rows.select(*KEY, "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "d0", digests(F.col("edited")).alias("d1"), "d2")
    cells = rows.withColumn("c0", sketch(F.col("d0")))
    tried = cells.select(*cells.columns, *[peel(minus(F.col("c0"), sketch(F.col(f"d{k}")))).alias(f"r{k}") for k in (1, 2)])
    base = cut(tried.select(*KEY, "id", "n_chars", "edited_sha256", "c0", "d0", "d1", F.when(~F.col("r2.whole"), F.col("d2")).alias("d2"), F.size("d2").alias("s2"), "r1", "r2"))
    pair = lambda k: F.struct(F.lit(k).alias("of"), F.col("d0").alias("a"), F.col(f"d{k}").alias("b"), F.col(f"r{k}.whole").alias("whole"))
    items = base.select(*KEY, F.explode(F.array(pair(1), pair(2))).alias("o")).where("NOT o.whole").select(*KEY, "o.of", F.lit(0).cast("long").alias("path"), "o.a", "o.b")
    done, level = None, 1
    while not items.isEmpty():
        judged = cut(_retry(items, level))
        now = judged.where("r.whole").select(*KEY, "of", "r.found")
        done = now if done is None else done.unionByName(now)
        items, level = judged.where("NOT r.whole"), level + 1
    if done is None:
        joined = base.withColumns({f"later{k}": F.lit(0).cast("long") for k in (1, 2)})
    else:
        later = done.groupBy(*KEY).agg(*[F.coalesce(F.sum(F.when(F.col("of") == k, F.col("found"))), F.lit(0)).alias(f"later{k}") for k in (1, 2)])
        joined = base.join(later, KEY, "left")
    differ = lambda k: F.when(F.col(f"r{k}.whole"), F.col(f"r{k}.found")).otherwise(F.coalesce(F.col(f"later{k}"), F.lit(0)))
    near = lambda k, size: 1 - differ(k) / F.greatest(F.size("d0") + size, F.lit(1))
    return joined.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", written(F.col("c0")).alias("fingerprint"), written(sketch(F.col("d1"))).alias("edited_fingerprint"),
        near(1, F.size("d1")).alias("near_edited"), near(2, F.col("s2")).alias("near_next"), F.size("d0").cast("long").alias("n_paragraphs"), differ(1).alias("differing"),
    )
