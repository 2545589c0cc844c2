"""N-gram Jaccard join by PartEnum signatures.

Sets of shingles are dealt to bands of sizes, so that two linked sets lie in one band or in neighbouring ones. In a
band whose largest size is u, linked sets differ in at most k = 2u (1 - s) / (1 + s) shingles, s being the similarity.
The domain of shingles is dealt to (k + 1) / 2 partitions, so that linked sets differ by one shingle at most in some
partition, and each partition to three parts, of which two then hold the same shingles of both. A signature is made of the
shingles of two parts of a partition, and every choice of two is taken: linked sets share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import set_links as S
from .common import cut, xor_key

#: Words of a shingle, and the similarity from which sets are linked.
RULE = S.Alike(shingle=3, num=90, den=100)
#: Parts of a partition; the shingles of all but one make a signature.
PARTS = 3


def bands(largest: int, rule: S.Alike) -> tuple[np.ndarray, np.ndarray]:
    """The least size of each band of sizes up to ``largest`` and of one more, and by how many shingles linked sets may differ up to it."""
    low, differ = [1], []
    while len(differ) < 2 or low[-2] <= largest:
        high = low[-1] * rule.den // rule.num
        differ.append(2 * high * (rule.den - rule.num) // (rule.den + rule.num))
        low.append(high + 1)
    return np.array(low[:-1]), np.array(differ)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Fixed values of a 64-bit finaliser that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def signatures(h: np.ndarray, at: np.ndarray, rule: S.Alike = RULE) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of all sets and the offsets of the rows: of its own band and of the next; none of an empty set."""
    size = np.diff(at)
    low, differ = bands(int(size.max(initial=1)), rule)
    row = np.flatnonzero(size)
    own = np.searchsorted(low, size[row], "right") - 1
    # Each set twice, once for each band.
    row, band = np.repeat(row, 2), np.repeat(own, 2) + np.tile([0, 1], len(own))
    k = differ[band]
    partitions = np.where(k == 0, 1, (k + 2) // 2)
    parts = np.where(k == 0, 1, PARTS)
    base = np.cumsum(partitions * parts) - partitions * parts
    count = size[row]
    take = np.repeat(at[row] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    of = np.repeat(np.arange(len(row)), count)
    token = h[take]
    total = np.zeros(int((partitions * parts).sum()), np.uint64)
    cell = base[of] + (_mixed(token) % (partitions * parts)[of].astype(np.uint64)).astype(np.int64)
    np.add.at(total, cell, token)
    out, owner = [], []
    whole = np.flatnonzero(k == 0)
    out.append(_mixed(total[base[whole]] ^ _mixed(band[whole].astype(np.uint64))))
    owner.append(row[whole])
    many = np.flatnonzero(k > 0)
    which = np.repeat(many, partitions[many])
    number = np.arange(len(which)) - np.repeat(np.cumsum(partitions[many]) - partitions[many], partitions[many])
    start = base[which] + PARTS * number
    every = total[start] + total[start + 1] + total[start + 2] if len(start) else np.zeros(0, np.uint64)
    for left_out in range(PARTS):
        name = _mixed(((band[which] << 32) + PARTS * number + left_out + 1).astype(np.uint64))
        out.append(_mixed((every - total[start + left_out]) ^ name))
        owner.append(row[which])
    sig, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return sig[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])


def with_signatures(docs: DataFrame, id_col: str, text_col: str, rule: S.Alike) -> DataFrame:
    """Rows (id, th, node, n, bits, signatures): hashes of the text and of its set, the set's size, bitmap and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, at in S.set_batches(batches, rule.shingle):
            sig, ends = signatures(h, at, rule)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *S.set_keys(h, at), S.lists(sig, ends)], names=["id", "th", "node", "n", "bits", "signatures"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), xor_key(text).alias("th"), text.alias("text")).mapInArrow(run, f"id {kind}, th long, node long, n long, bits array<long>, signatures array<long>")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: S.Alike = RULE, growth: int = S.GROWTH) -> DataFrame:
    """One row (id, n_shingles, component_id) for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A document's set holds its distinct shingles
    of ``rule.shingle`` words, the whole sequence of fewer words. Documents of a similarity of ``rule.num / rule.den``
    or more are linked; ``component_id`` is the smallest id that links reach, the row's own included. All links count:
    signatures bring every linked pair together. Shingles are equal if their 64-bit hashes are.

    A null or blank text has an empty set and links to nothing: its component is its own id. Null ids take part but
    are never a component's id, unless all of its ids are null. Repeated rows and ids each give a row. Other columns
    of ``docs`` are neither read nor returned. An empty table gives an empty result.
    """
    rows = cut(with_signatures(docs, id_col, text_col, rule))
    entries = rows.select(F.explode("signatures").alias("cell"), "node", F.lit(True).alias("short"))
    roots = S.connected(entries, rows.where("n > 0"), docs, text_col, rule, growth)
    groups = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    of = groups.join(roots, "node", "left").select("node", "copies", "least", "root")
    # Only sets of several rows or with links are looked up; a row alone is its own component.
    linked = of.where(F.col("root").isNotNull())
    best = linked.groupBy("root").agg(F.min("least").alias("component"))
    alone = of.where(F.col("root").isNull() & (F.col("copies") > 1)).select("node", F.col("least").alias("component"))
    many = cut(linked.join(best, "root").select("node", "component").unionByName(alone)).withColumnRenamed("node", "found")
    return rows.join(many, rows.node == many.found, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("found").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id")
    )


#: The query's result in SQL: all pairs that share a shingle are counted, then links are followed.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS shingles FROM words),
each AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS t FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.doc_id)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, min(root) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(shingles)
"""
