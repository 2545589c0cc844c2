"""SimHash near-dedup by segment popcounts, a grid range join and exact verification.

A fingerprint's embedding is the bit count of each of its 32 two-bit segments, a cell of a grid. The Manhattan
distance of embeddings is at most the Hamming distance of fingerprints, so those within ``LINK`` = 2 bits lie in cells
within 2 of each other, and some cell is within 1 of both. Each fingerprint therefore goes to its own cell and to those
within 1 of it, and fingerprints that meet in a cell are joined if their embeddings are within 2 and then if they
differ in 2 bits at most. A cell of many fingerprints is split on the bits of its segments, a finer grid whose cells are
the fingerprints that the cell's own become by one changed bit: all of one such point are within two bits of each other,
so they are linked in a chain, which takes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytewise as B
from . import set_links as S
from .common import cut, hash_bound, smallest_reachable, xor_key

LINK = 2
#: Fingerprints of a cell up to which they are joined in pairs; a larger cell is split.
CELL = 64
#: Of ``keep_one``: texts are near-duplicates from a Jaccard similarity of 4/5 of their sets of five-word shingles on.
RULE = S.Alike(shingle=5, num=4, den=5)


def _lanes() -> np.ndarray:
    """For each byte, its bits one to a byte of a 64-bit word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


LANES = _lanes()


def bit_counts(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many of its shingle hashes have each of the 64 bits, and how many hashes there are."""
    rows = len(offsets) - 1
    h, row = S.shingles(raw, offsets, shingle)
    n = np.bincount(row, minlength=rows)
    found = np.zeros((rows, 64), np.int64)
    live = np.flatnonzero(n)
    if not len(live):
        return found, n
    # Bit counts in byte-wide lanes over blocks of up to 255 hashes of one row.
    head = (np.cumsum(n) - n)[live]
    blocks = (n[live] + 254) // 255
    heads = np.cumsum(blocks) - blocks
    cuts = np.repeat(head, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(heads, blocks))
    octets = h.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(LANES[octets[:, byte]], cuts).view(np.uint8).reshape(-1, 8)
        found[live, 8 * byte : 8 * byte + 8] = np.add.reduceat(lanes, heads, axis=0, dtype=np.int64)
    return found, n


def _long_counts(raw: np.ndarray, shingle: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``bit_counts`` of one long text, part by part; the last words of a part begin the next."""
    found, n, carry = np.zeros((1, 64), np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint8)
    for part in B.cuts(raw, most=most):
        text = np.concatenate([carry, part])
        start, end, _ = B.words(text, np.array([0, len(text)]))
        if len(start) >= shingle:
            ones, count = bit_counts(text, np.array([0, len(text)]), shingle)
            found, n = found + ones, n + count
            start = start[len(start) - shingle + 1 :]
        carry = text[start[0] : end[-1]] if shingle > 1 and len(start) else text[:0]
    return (found, n) if n[0] else bit_counts(carry, np.array([0, len(carry)]), shingle)


def fingerprints(raw: np.ndarray, offsets: np.ndarray, shingle: int = 3, most: int = 1 << 20) -> np.ndarray:
    """The SimHash of each row as unsigned 64-bit integers; zero for a row of no words."""
    out = [np.zeros(0, np.uint64)]
    for i, j in B.pieces(offsets, most):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        ones, n = _long_counts(part, shingle, most) if j == i + 1 and len(part) > most else bit_counts(part, at, shingle)
        out.append(np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel())
    return np.concatenate(out)


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """Rows (id, fp): ``fp`` holds the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = B.text_column(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(raw, offsets, shingle).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, 0, 1 and 2 written as 00, 01 and 11: embeddings differ in as many bits as their Manhattan distance."""
    low = F.lit(0x5555555555555555)
    up = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseOR(up).bitwiseAND(low))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bit(x: Column, k: int) -> Column:
    return x.bitwiseAND(F.lit(_signed(1 << k))) != 0


def nearby(cell: Column) -> Column:
    """The cell and those within 1 of it: a segment of no bits gains one, of two loses one, of one does either."""
    more = [F.when(~_bit(cell, 2 * k + 1), cell.bitwiseXOR(F.lit(1 << 2 * k))) for k in range(32)]
    less = [F.when(_bit(cell, 2 * k), cell.bitwiseXOR(F.lit(_signed(2 << 2 * k)))) for k in range(32)]
    return F.array_compact(F.array(cell, *more, *less))


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` of at most ``LINK`` differing bits.

    They connect exactly what all such pairs connect. Null fingerprints link to nothing.
    """
    met = fps.dropna().select("fp", F.explode(nearby(embedding(F.col("fp")))).alias("cell"))
    held = cut(met.groupBy("cell").agg(F.count("*").alias("m"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("m > 1"))
    near = F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b")))) <= LINK
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK
    some = held.where(f"m BETWEEN 3 AND {cell}").select("cell")
    member = cut(met.join(F.broadcast(some) if some.count() <= S.SMALL else some, "cell"))
    pairs = member.withColumnRenamed("fp", "a").join(member.withColumnRenamed("fp", "b"), "cell").where("a < b").select("a", "b")
    few = held.where("m = 2").select("a", "b").unionByName(pairs).where(near).where(exact)
    # Fingerprints of a large cell once at each point within a bit of them that lies in the cell.
    large = held.where(F.col("m") > cell).select("cell")
    large = F.broadcast(large) if large.count() <= S.SMALL else large
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    fine = met.join(large, "cell").select("cell", "fp", F.explode(points).alias("point")).where(embedding(F.col("point")) == F.col("cell"))
    chain = fine.select(F.lag("fp").over(Window.partitionBy("cell", "point").orderBy("fp")).alias("a"), F.col("fp").alias("b")).where("a IS NOT NULL")
    return few.unionByName(chain).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (id, fingerprint, component_id) for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles of ``shingle``
    words, repeats included, or the whole of a shorter text, are hashed with XXH64 (seed 42); a bit
    is set if it is in over half the hashes. Fingerprints link at ``LINK`` or fewer differing bits;
    ``component_id`` is the smallest id that links reach, the row's own included.

    A null or blank text has fingerprint zero and links like any other. Null ids take part but are
    never a component's id, unless all of its ids are null. Repeated rows and ids each give a row.
    Other columns of ``docs`` are neither read nor returned. An empty table gives an empty result.
    """
    rows = cut(with_fingerprint(docs, id_col, text_col, shingle))
    groups = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = smallest_reachable(links(groups.select("fp")), "a", "b")
    of = groups.join(roots, groups.fp == roots.node, "left").select("fp", "n", "least", "root")
    # Only groups of several rows or with links are looked up; a row alone is its own component.
    linked = of.where(F.col("root").isNotNull())
    best = linked.groupBy("root").agg(F.min("least").alias("component"))
    many = linked.join(best, "root").select("fp", "component").unionByName(of.where(F.col("root").isNull() & (F.col("n") > 1)).select("fp", F.col("least").alias("component")))
    many = cut(many)
    hit = many.withColumnRenamed("fp", "node")
    return rows.join(hit, rows.fp == hit.node, "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )


def with_prefix(docs: DataFrame, id_col: str, text_col: str, common: tuple[np.ndarray, np.ndarray], rule: S.Alike = RULE) -> DataFrame:
    """Rows (id, th, node, n, bits, prefix): hashes of the text and of its shingle set, the set's size, bitmap and prefix.

    A prefix is the first of a set's hashes in one order for all sets: those in ``common`` (ascending hashes, counts)
    last and by count, else by value. It is as long as a set may have hashes, and one more, that a linked smaller set
    lacks, a fifth of its ``n`` at a similarity of 0.8.
    """
    known, counts = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, at in S.set_batches(batches, rule.shingle):
            keys, size = S.set_keys(h, at), np.diff(at)
            row = np.repeat(np.arange(len(size)), size)
            if len(known):
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                seen = np.where(known[k] == h, counts[k], 0)
                h = h[np.lexsort((h, seen, row))]
            keep = np.arange(len(h)) - at[row] < (size * (rule.den - rule.num) // rule.den + 1)[row]
            prefix = S.lists(h[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(size)))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *keys, prefix], names=["id", "th", "node", "n", "bits", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    schema = f"id {kind}, th long, node long, n long, bits array<long>, prefix array<long>"
    return docs.select(F.col(id_col).alias("id"), xor_key(text).alias("th"), text.alias("text")).mapInArrow(run, schema)


def _common(docs: DataFrame, text_col: str, rule: S.Alike = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, and their counts, found in many texts of a sample, 100,000 at most.

    They only order the prefixes, so that a common line seldom brings texts together; which they are
    changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, _ in S.set_batches(batches, rule.shingle):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["token"])

    some = docs.where(F.xxhash64(F.lit(7), F.col(text_col)) <= hash_bound(0.1)).select(F.col(text_col).alias("text"))
    often = some.mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "token").limit(100_000)
    found = often.toArrow()
    tokens, counts = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefix_cells(rows: DataFrame, rule: S.Alike = RULE) -> DataFrame:
    """Rows (cell, node, short): the hashes of the prefixes, each a cell.

    Linked sets share a hash of the larger one's prefix and of the first few hashes of the smaller one, of which the larger may
    lack only so many: a ninth at a similarity of 0.8, and one more. In these the smaller is ``short``.
    """
    few = F.expr(f"n * {rule.den - rule.num} div {rule.den + rule.num} + 1")
    return rows.select("node", "n", F.posexplode("prefix").alias("at", "cell")).select("cell", "node", (F.col("at") < few).alias("short"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", growth: int = S.GROWTH) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of its smallest id.

    Texts whose sets of five-word shingles (words and short texts as in ``near_duplicates``) have a
    Jaccard similarity of 0.8 or more are linked; groups are what links reach. All such pairs
    are found: similarity 0.8 leaves SimHash fingerprints about ten bits apart, more than a grid of
    bit counts can bridge, so candidates share a shingle of their sets' prefixes instead. Sets are
    equal if their 64-bit hashes are; null and blank texts are alike.

    Of a group the row of the smallest (id, text hash) stays, null ids last. Ids may be null or
    repeat: rows are told apart by id and text, and only rows equal in both are one document.
    """
    rows = cut(with_prefix(docs, id_col, text_col, _common(docs, text_col)))
    roots = S.connected(prefix_cells(rows), rows, docs, text_col, RULE, growth)
    found = cut(rows.join(roots, "node", "left").select("id", "th", F.coalesce("root", "node").alias("root")))
    key = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    least = found.groupBy("root").agg(F.min(key).alias("least"))
    gone = found.join(least, "root").where(key != F.col("least"))
    return _without(docs, gone, found, id_col, text_col)


def _without(docs: DataFrame, gone: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows (id, th) of ``gone``; of rows of ``found`` equal in both, one."""
    gone = gone.select(F.col("id").alias("__sh_id"), F.col("th").alias("__sh_th")).distinct()
    again = found.groupBy(F.col("id").alias("__sh_id"), F.col("th").alias("__sh_th")).count().where("count > 1").drop("count")
    gone, again = cut(gone), cut(again)
    same = F.col(id_col).eqNullSafe(F.col("__sh_id")) & (xor_key(F.col(text_col)) == F.col("__sh_th"))
    stay = docs.join(gone, same, "left_anti")
    return stay.join(again, same, "left_anti").unionByName(stay.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``: that of its smallest (id, text hash), null ids last.

    Ids may be null or repeat: rows are told apart by id and text, and only rows equal in both are one document.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), xor_key(F.col(text_col)).alias("th"))
    found = cut(near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", shingle).select("key.id", "key.th", (F.col("key") != F.col("component_id")).alias("gone")))
    return _without(docs, found.where("gone"), found, id_col, text_col)
