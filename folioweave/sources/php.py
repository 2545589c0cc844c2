"""PHP's serialised values, a nested format of length-prefixed texts, as leaves, by one scan with a stack."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value of the format: what a value or a key begins with, up to where its own bytes or members follow.
_HEAD = re.compile(rb"(?:(N);|([ibd]):([^;]{1,40});|(s):([0-9]{1,10}):\"|(a):[0-9]{1,10}:\{|O:[0-9]{1,10}:\"([^\"]{1,200})\":[0-9]{1,10}:\{|(\}))")
_LEAF = "struct<path:array<string>,type:string,value:string>"


def _scanned(raw: bytes) -> list[tuple[list[str], str, str | None]] | None:
    """The leaves of one text in their order; null if it isn't a serialised value."""
    at, depth, key, path, found = 0, 0, False, [], []
    while True:
        head = _HEAD.match(raw, at)
        if head is None:
            return None
        at = head.end()
        if head[8]:
            if not key:
                return None
            depth -= 1
        elif head[6] or head[7]:
            if key:
                return None
            depth, key = depth + 1, True
            continue
        else:
            kind, value = ("N", None) if head[1] else ("s", None) if head[4] else (head[2].decode(), head[3].decode("latin-1"))
            if head[4]:
                end = at + int(head[5])
                if raw[end : end + 2] != b'";':
                    return None
                value, at = raw[at:end].decode("utf-8", "replace"), end + 2
            if key:
                if kind not in "is":
                    return None
                path.append(value)
                key = False
                continue
            found.append((path[:], kind, value))
        # A value is over: at the top all is, else the next key comes.
        if depth == 0:
            return found if at == len(raw) else None
        path.pop()
        key = True


def _column(rows: list) -> pa.Array:
    """Leaves of texts as Arrow holds them."""
    flat = [leaf for row in rows for leaf in row or ()]
    offsets, total = [], 0
    for row in rows:
        offsets.append(None if row is None else total)
        total += len(row or ())
    fields = [pa.array([leaf[0] for leaf in flat], pa.list_(pa.string())), pa.array([leaf[1] for leaf in flat], pa.string()), pa.array([leaf[2] for leaf in flat], pa.string())]
    return pa.ListArray.from_arrays(pa.array([*offsets, total], pa.int32()), pa.StructArray.from_arrays(fields, names=["path", "type", "value"]))


def _leaves(column: pa.Array) -> pa.Array:
    return _column([None if raw is None else _scanned(raw) for raw in column.to_pylist()])


def _leaves_of_each(column: pa.Array) -> pa.Array:
    lists = column.to_pylist()
    rows = [None if raw is None else _scanned(raw) for x in lists for raw in x or ()]
    offsets, total = [], 0
    for x in lists:
        offsets.append(None if x is None else total)
        total += len(x or ())
    return pa.ListArray.from_arrays(pa.array([*offsets, total], pa.int32()), _column(rows))


def leaves(text: Column) -> Column:
    """The values of a serialised text that aren't arrays or objects: an array of (path, type, value) in their order; null for what isn't one.

    ``path`` has the keys of the arrays and objects around a value, its own last. Types are ``N``, ``i``, ``d``, ``b`` and ``s``; a null's value is null. Lengths count
    bytes of UTF-8, so a text may hold any signs, those of the format as well. Members of objects count by their names, private and
    protected ones with what PHP puts before them. References and custom serialised objects aren't read: null. The time is in proportion to the text.
    """
    return F.arrow_udf(_leaves, f"array<{_LEAF}>")(text.cast("binary"))


def leaves_of_each(texts_of: Column) -> Column:
    """``leaves`` of each text of an array; Spark takes no function of Python's within another's lambda."""
    return F.arrow_udf(_leaves_of_each, f"array<array<{_LEAF}>>")(texts_of.cast("array<binary>"))


def texts(leaves_of: Column, key: str) -> Column:
    """The texts under a key, at any depth, in order."""
    return F.transform(F.filter(leaves_of, lambda x: (x["type"] == "s") & (F.element_at(x["path"], -1) == key) & (F.size(x["path"]) > 0)), lambda x: x["value"])
