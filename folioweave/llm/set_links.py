"""Connecting shingle sets of a Jaccard similarity, from cells in which similar sets meet.

Whoever calls deals the sets to cells so that any two of enough similarity meet in one. Here cells are told apart
without gathering them, equal ones counted once, and their sets compared by leaders: first with one leader of a cell,
then with blocks of leaders that they aren't connected with yet. Sizes and bitmaps rule out most pairs within
the join; what is left is verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import cut, smallest_reachable, xor_key

#: How many times as large the next block of leaders is; the first one is a single set.
GROWTH = 64
#: Bits of a set's bitmap.
BITS = 512
#: Rows of keys that are broadcast, 24 bytes each; with more of them tables are shuffled.
SMALL = 250_000


@dataclass(frozen=True)
class Alike:
    """Sets of shingles of ``shingle`` words are linked if den * both >= num * union."""

    shingle: int
    num: int
    den: int

    def verified(self, both: Column, x: Column, y: Column) -> Column:
        return (self.den + self.num) * both >= self.num * (x + y)

    def sizes(self, x: Column, y: Column) -> Column:
        return self.den * F.least(x, y) >= self.num * F.greatest(x, y)

    def apart(self, x: Column, y: Column, differ: Column) -> Column:
        """Whether sets of x and y hashes that differ in ``differ`` of them at least may be linked."""
        return (self.den + self.num) * differ <= (self.den - self.num) * (x + y)


def shingles(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle of words, repeats included, and its row; none for a row of no words."""
    rows = len(offsets) - 1
    start, end, row = B.words(raw, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Single spaces between words: of a run of white space the first byte stays, as a space.
    gap = B.SPACE[raw]
    keep = ~gap
    keep[end[end < len(raw)]] = True
    text = np.where(gap, np.uint8(0x20), B.LOWER[raw])[keep]
    at = np.cumsum(keep) - 1
    start, end = at[start], at[end - 1] + 1
    count = np.bincount(row, minlength=rows)
    begin = np.cumsum(count) - count
    k = np.arange(len(start)) - begin[row]
    last = np.minimum(k + shingle - 1, count[row] - 1)
    full = (k + shingle <= count[row]) | (k == 0)
    first, row, last = start[full], row[full], end[(begin[row] + last)[full]]
    return B.xxh64(text, first, last - first), row


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, ascending in each row, and the offsets of the rows."""
    h, row = shingles(raw, offsets, shingle)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    size = np.bincount(row[new], minlength=len(offsets) - 1)
    return h[new], np.concatenate([[0], np.cumsum(size)])


def set_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches, whose last column is the text, with their shingle sets."""
    for batch in batches:
        raw, offsets = B.text_column(batch.column(batch.num_columns - 1))
        for i, j in B.pieces(offsets):
            h, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
            yield batch.slice(i, j - i), h, at


def lists(h: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))


def set_keys(h: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each set its hash, size and bitmap.

    Bit k of the bitmap tells whether an odd number of the set's hashes fall on k of ``BITS``: two bitmaps differ in
    at most as many bits as the sets in hashes.
    """
    size = np.diff(at)
    node = np.array([xxhash.xxh64_intdigest(h[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    odd = (np.bincount(row * BITS + (h >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=len(size) * BITS) & 1).astype(bool)
    bits = np.packbits(odd, bitorder="little").view(np.int64)
    bitmap = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * (BITS // 64), pa.int32()), pa.array(bits))
    return pa.array(node.view(np.int64)), pa.array(size.astype(np.int64)), bitmap


def _differ(x: Column, y: Column) -> Column:
    parts = [F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(BITS // 64)]
    return sum(parts[1:], parts[0])


def cells(entries: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the cells of two sets, and rows (cell, m, node, short, n, bits) of the larger cells, each of ``m`` sets.

    ``entries`` has (cell, node, short) for each set of a cell, for copies of a set once or more often. Cells without a ``short`` set make no pair and go;
    of cells of the same sets one stays. A cell is known by sums over its sets, no cell is gathered.
    """
    sums = entries.groupBy("cell").agg(F.count("*").alias("rows"), F.min("node").alias("a"), F.max("node").alias("b"), F.max("short").alias("some"))
    sums = cut(sums.where("a <> b AND some"))
    large = sums.where("rows > 2").select("cell")
    members = cut(entries.join(F.broadcast(large) if large.count() <= SMALL else large, "cell").groupBy("cell", "node").agg(F.max("short").alias("short")))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node", "short")).alias(f"x{k}") for k in (1, 2)]
    one = members.groupBy("cell").agg(F.count("*").alias("m"), *marks).groupBy("m", "x1", "x2").agg(F.min("cell").alias("cell"))
    kept = members.join(one.select("cell", "m"), "cell").join(nodes.select("node", "n", "bits"), "node")
    return sums.where("rows = 2").select("a", "b").distinct(), cut(kept.select("cell", "m", "node", "short", "n", "bits"))


def likely(pairs: DataFrame, nodes: DataFrame, rule: Alike) -> DataFrame:
    """Those of the pairs (a, b) that sizes and bitmaps allow to be linked."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("x"), F.col("bits").alias("xs"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("y"), F.col("bits").alias("ys"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(rule.sizes(F.col("x"), F.col("y")) & rule.apart(F.col("x"), F.col("y"), _differ(F.col("xs"), F.col("ys")))).select("a", "b")


def meet(lead: DataFrame, live: DataFrame, rule: Alike) -> DataFrame:
    """Node pairs (a, b) of a leader and another set of its cell, not connected yet, that sizes and bitmaps allow to be linked.

    The smaller of the two, by size, then node, must be ``short`` there.
    """
    a = lead.select("cell", F.col("node").alias("a"), F.col("root").alias("top"), F.col("n").alias("na"), F.col("bits").alias("bitsa"), F.col("short").alias("shorta"))
    less = (F.col("na") < F.col("n")) | ((F.col("na") == F.col("n")) & (F.col("a") < F.col("node")))
    role = F.when(less, F.col("shorta")).otherwise(F.col("short"))
    on = (live.cell == a.cell) & (F.col("root") != F.col("top")) & role & rule.sizes(F.col("n"), F.col("na"))
    on &= rule.apart(F.col("n"), F.col("na"), _differ(F.col("bits"), F.col("bitsa")))
    return cut(live.join(a, on).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, rule: Alike) -> DataFrame:
    """Those of the node pairs (a, b) whose shingle sets are linked; ``rows`` has (th, node), the hashes of texts and of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, at in set_batches(batches, rule.shingle):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(h, at)], names=["node", "tokens"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # One text of each node; its set is formed anew, as to keep all sets takes more disk than the texts.
    of = cut(rows.join(asked, "node").groupBy("node").agg(F.min("th").alias("th")))
    of = F.broadcast(of) if of.count() <= SMALL else of
    texts = docs.select(xor_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text")).join(of, "th").select("node", "text")
    # Not checkpointed: both joins below take the sets as they are dealt by node here, and share that shuffle.
    sets = texts.mapInArrow(run, "node long, tokens array<long>").dropDuplicates(["node"])
    left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return cut(pairs.join(left, "a").join(right, "b").where(rule.verified(both, F.size("x"), F.size("y"))).select("a", "b"))


def _joined(roots: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """``roots`` (node, root) after linked ``pairs`` (a, b) of nodes: only pairs of different roots are followed."""
    if roots is None:
        return smallest_reachable(pairs, "a", "b")
    for end in ("a", "b"):
        of = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        pairs = pairs.join(of, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    tops = smallest_reachable(pairs.select("a_root", "b_root").distinct(), "a_root", "b_root").select(F.col("node").alias("top"), F.col("root").alias("next"))
    old = roots.join(tops, roots.root == tops.top, "left").select("node", F.coalesce("next", "root").alias("root"))
    new = tops.join(roots, tops.top == roots.node, "left_anti").select(F.col("top").alias("node"), F.col("next").alias("root"))
    return cut(old.unionByName(new))


def connected(entries: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, rule: Alike, growth: int = GROWTH) -> DataFrame:
    """Rows (node, root): what the linked pairs that meet in a cell of ``entries`` connect; ``rows`` has (th, node, n, bits) of each text.

    Pairs of cells of two, and the sets of each larger cell with its first leader, come first, which connects most of a
    large group of near copies. Rounds of ``growth`` leaders of each cell, and ``growth`` times as many each,
    follow, compared with the sets that aren't connected with them, until all of a cell is connected or compared, so no
    pair is lost. Sets are in the order of their hashes, whose place among all hashes tells about how many of the cell
    come before.
    """
    nodes = cut(rows.select("node", "n", "bits").dropDuplicates(["node"]))
    two, members = cells(entries, nodes)
    first = members.where("short").groupBy("cell").agg(F.min("node").alias("lead"))
    ahead = members.join(first, "cell").where("lead <> node").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
    roots = _joined(None, verified(cut(likely(two.unionByName(ahead).distinct(), nodes, rule)), rows, docs, text_col, rule))
    place = (F.col("node") / 2.0**64 + 0.5) * F.col("m")
    done, step = 0, max(2, growth)
    while True:
        live = members.where(F.col("m") >= done).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        unlike = live.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        # A place may be rounded up to m itself.
        live = cut(live.join(unlike, "cell", "left_semi"))
        if live.isEmpty():
            return roots
        pairs = meet(live.where(F.col("short") & (place >= done) & (place < done + step)), live, rule)
        if not pairs.isEmpty() and not (found := verified(pairs, rows, docs, text_col, rule)).isEmpty():
            roots = _joined(roots, found)
        done, step = done + step, step * max(2, growth)
