"""JSON records as leaf paths, and back: nested headers of any depth, and a merge of objects by path."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Leaf paths of a table at most, as each becomes a column.
MOST_PATHS = 10_000
#: Headers of the files read at once, at most, as each becomes an expression.
MOST_HEADERS = 200


def depth(text: Column) -> Column:
    """How many objects and arrays of a JSON text lie within each other at most."""
    signs = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"]).alias("most"))
    end = F.aggregate(F.filter(F.split(signs, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)
    return F.greatest(end["most"], end["now"])


def _own(key: Column) -> Column:
    """A key as a step of a JSON path."""
    return F.when(F.contains(key, F.lit("'")), F.concat(F.lit('["'), key, F.lit('"]'))).otherwise(F.concat(F.lit("['"), key, F.lit("']")))


def _deepest(rows: DataFrame, json_col: str) -> int:
    return rows.agg(F.max(depth(F.col(json_col))).alias("d")).first()["d"] or 0


def leaves(rows: DataFrame, json_col: str, by: list[str], arrays: bool = True, levels: int | None = None) -> DataFrame:
    """Rows (by, steps, place, type, v): each value of a row's JSON text that isn't an object or, with ``arrays``, an array.

    ``steps`` are the keys and numbers that lead to it, ``place`` is its JSON path and ``type`` what Spark calls it;
    with ``arrays`` turned off an array is a value. Empty objects are values of type OBJECT<>. Texts that aren't JSON, and nulls at the top, have no leaves.

    The deepest nesting is looked up first, unless it is given as ``levels``; then all rows are taken apart level by level in one plan.
    """
    levels = _deepest(rows, json_col) if levels is None else levels
    blank = F.array().cast("array<string>")
    out = rows.select(*by, blank.alias("steps"), F.lit("$").alias("place"), F.try_parse_json(F.col(json_col)).alias("v")).where("v IS NOT NULL")
    child = lambda step, at, v: F.struct(step.alias("step"), at.alias("at"), v.alias("v"))
    for _ in range(levels):
        v = F.col("v")
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        as_is = F.array(child(F.lit(None).cast("string"), F.lit(""), v))
        of_array = lambda xs: F.when(xs.isNotNull(), F.transform(xs, lambda x, i: child(i.cast("string"), F.concat(F.lit("["), i.cast("string"), F.lit("]")), x))).otherwise(as_is)
        other = let(F.try_variant_get(v, "$", "array<variant>"), of_array) if arrays else as_is
        # What a value is shows by what it can be read as: its schema takes a walk through all that is below it.
        apart = let(entries, lambda es: F.when(F.size(es) > 0, F.transform(es, lambda e: child(e["key"], _own(e["key"]), e["value"]))).otherwise(other))  # noqa: B023
        out = out.select(*by, "steps", "place", F.explode(apart).alias("c"))
        out = out.select(*by, F.when(F.col("c.step").isNull(), F.col("steps")).otherwise(F.array_append("steps", F.col("c.step"))).alias("steps"), F.concat("place", "c.at").alias("place"), F.col("c.v").alias("v"))
    # A place is one value, whether or not its row was taken apart to the last level.
    return out.select(*by, "steps", "place", F.schema_of_variant("v").alias("type"), "v")


def leaf_paths(rows: DataFrame, json_col: str) -> list[tuple[str, list[str]]]:
    """The dotted names of all leaves that aren't null or empty, in order, each with the JSON paths that it stands for."""
    own = leaves(rows, json_col, []).where("type NOT IN ('VOID', 'OBJECT<>') AND try_variant_get(v, '$', 'string') <> '' AND size(steps) > 0")
    found = own.select(F.array_join("steps", ".").alias("name"), "place").distinct().limit(MOST_PATHS + 1).collect()
    if len(found) > MOST_PATHS:
        raise ValueError(f"more than {MOST_PATHS} leaf paths")
    names: dict[str, list[str]] = {}
    for name, place in sorted(found):
        names.setdefault(name, []).append(place)
    return list(names.items())


def write_leaf_tsv(rows: DataFrame, json_col: str, path: str) -> list[str]:
    """Write JSON records as tab-separated values with a column for each leaf path of any of them; returns the header.

    Columns are in order of name; lists are numbered from 0. Tabs and line ends within a value become a space.
    """
    names = leaf_paths(rows, json_col)
    parsed = rows.select(F.try_parse_json(F.col(json_col)).alias("v"))
    text = lambda place: F.try_variant_get(F.col("v"), place, "string")
    cells = [F.regexp_replace(F.coalesce(*map(text, places)), r"[\t\r\n]+", " ").alias(name) for name, places in names]
    if cells:
        parsed.select(*cells).write.options(sep="\t", header=True, quote="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return [name for name, _ in names]


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return F.when(c.isNotNull(), let(F.to_json(F.struct(c.alias("x"))), lambda whole: F.substr(whole, F.lit(6), F.length(whole) - 6)))


def nested(header: list[str], cell) -> Column:
    """The JSON object that a row's cells make under dotted names of any depth; null if all are blank.

    ``cell`` gives the column of a name's place in the header. Names of one level that are all numbers make a list, in
    order of number. Blank cells are left out, and what has nothing in it. A cell under a name that others go on from
    takes the place of what they make, unless it is blank; of a name twice in the header the first that isn't blank counts.
    """
    tree: dict = {}
    for k, name in enumerate(header):
        at = tree
        for step in name.split("."):
            at = at.setdefault(step, {})
        at.setdefault(None, []).append(k)

    def made(at: dict) -> Column:
        own = [_quoted(F.nullif(F.regexp_replace(cell(k), r"^\s+$", ""), F.lit(""))) for k in at.get(None, [])]
        below = {s: made(x) for s, x in at.items() if s is not None}
        if below:
            listed = all(s.isdecimal() for s in below)
            ordered = sorted(below.items(), key=lambda x: int(x[0])) if listed else below.items()
            members = F.array_compact(F.array(*[x if listed else F.concat(F.lit(f"{json.dumps(s, ensure_ascii=False)}:"), x) for s, x in ordered]))
            signs = "[]" if listed else "{}"
            own.append(let(members, lambda m: F.when(F.size(m) > 0, F.concat(F.lit(signs[0]), F.array_join(m, ","), F.lit(signs[1])))))
        return F.coalesce(*own)

    return made(tree) if tree else F.lit(None).cast("string")


def nested_records(rows: DataFrame) -> DataFrame:
    """The rows of ``tsv.read_tsv`` with ``record``, a JSON object of their cells; dotted names are members at any depth.

    Headers are looked up first, one for each file at most, ``MOST_HEADERS`` different ones.
    """
    headers = [r["names"] for r in rows.select("names").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(headers) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    record = F.lit(None).cast("string")
    for names in headers:
        same = F.col("names") == F.array(*[F.lit(n) for n in names]) if names else F.size("names") == 0
        record = F.when(same, nested(names, lambda k: F.get(F.col("cells"), F.lit(k)))).otherwise(record)
    return rows.withColumn("record", record)


def merged_objects(rows: DataFrame, json_col: str, by: list[str], order: str) -> DataFrame:
    """One JSON object (by, merged) for each group: its rows' objects, merged by path in order of ``order``.

    Numbers of a path add up, arrays are joined in order, texts and booleans take the last value, objects are merged in
    turn; nulls count as nothing. Where rows differ in kind an object goes before an array, an array before a number, a number before a
    text. Keys come in order. Rows that aren't objects are left out, groups of none too; ties in ``order`` are in order
    of the values. The order of rows plays no part, and decimals add up exactly (38 digits, 10 after the point).

    Values are summed up by path before a group's paths meet, so a task holds the paths of a group, not its rows; only
    joined arrays grow with the rows, as the result does.
    """
    own = rows.where(F.startswith(F.ltrim(F.col(json_col)), F.lit("{")))
    levels = _deepest(own, json_col)
    found = leaves(own.withColumn("__order", F.col(order)), json_col, [*by, "__order"], arrays=False, levels=levels).where("type <> 'VOID'")
    kind = F.when(F.col("type") == "OBJECT<>", 3).when(F.startswith("type", F.lit("ARRAY<")), 2).when(F.col("type").isin("STRING", "BOOLEAN"), 0).otherwise(1)
    text, number = F.col("v").cast("string"), F.expr("try_variant_get(v, '$', 'decimal(38,10)')")
    items = F.transform(F.try_variant_get(F.col("v"), "$", "array<variant>"), lambda x: F.to_json(x))
    listed = F.when(kind == 2, F.struct(F.col("__order").alias("o"), items.alias("items")))
    sums = found.groupBy(*by, "steps").agg(
        F.max(kind).alias("kind"), F.sum(F.when(kind == 1, number)).alias("number"),
        F.flatten(F.transform(F.array_sort(F.collect_list(listed)), lambda x: x["items"])).alias("items"),
        F.max(F.when(kind == 0, F.struct(F.col("__order").alias("o"), F.when(F.col("type") == "BOOLEAN", text).otherwise(F.to_json("v")).alias("t")))).alias("last"),
    )
    plain = F.regexp_replace(F.col("number").cast("string"), r"\.?0+$", "")
    value = F.when(F.col("kind") == 3, "{}").when(F.col("kind") == 2, F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))).when(F.col("kind") == 1, plain).otherwise(F.col("last.t"))
    # From here on all of a group's paths are in one place, and the levels need no further shuffle.
    at = sums.select(*by, "steps", F.when(F.col("kind") == 3, 0).otherwise(1).alias("leaf"), value.alias("json"))
    at = at.repartition(*by) if by else at
    for level in range(levels, 0, -1):
        # Each level takes the rows once: what is deepest joins to its parent's members, the rest stays.
        deep = F.size("steps") == level
        up = F.when(deep, F.slice("steps", 1, level - 1)).otherwise(F.col("steps")).alias("steps")
        member = F.struct(F.try_element_at("steps", F.lit(-1)).alias("k"), "json")
        own = at.groupBy(*by, up).agg(F.array_sort(F.collect_list(F.when(deep, member))).alias("members"), F.max(F.when(~deep, F.struct("leaf", "json"))).alias("x"))
        whole = F.concat(F.lit("{"), F.array_join(F.transform("members", lambda m: F.concat(_quoted(m["k"]), F.lit(":"), m["json"])), ","), F.lit("}"))
        # Members take the place of an array, number or text of their own path, and of an object without any.
        some = F.size("members") > 0
        at = own.select(*by, "steps", F.when(some, 2).otherwise(F.col("x.leaf")).alias("leaf"), F.when(some, whole).otherwise(F.col("x.json")).alias("json"))
    return at.where(F.size("steps") == 0).select(*by, F.col("json").alias("merged"))
