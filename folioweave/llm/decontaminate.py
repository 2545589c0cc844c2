"""Benchmark decontamination: rare pairs of words as seeds, then Smith-Waterman alignment.

An alignment gains two a common word and loses one an error, and counts from ``least`` of the
item's perfect score on. Two of its common words in a row are *near* if one error at most lies
between them: the text and the item then share a pair of words that are at most two apart in each.
An alignment that counts over an item of ``n`` words has ``least * n - 1`` near pairs or more, since
every other step costs two errors. So if the pairs that begin at fewer item words than that are left
out, one of those that stay is still in the passage. The most frequent are left out: seeds are the
rarer pairs of each item, of the rarest half for ``least`` 0.5, and no passage is lost, however
frequent or rare the seeds are in the documents.

One pass over the documents counts the pairs by 22 bits of their hashes. Tasks then write the
benchmark in blocks of a bounded size to the shared folder. A second pass finds each block's seeds,
takes the passages around them, drops those with fewer near pairs than needed, and aligns the rest.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewise as B
from .common import fresh_path, full_uri, store_of

SCORE = 0.5
HIT, MISS, SKIP = 2, -1, -1
#: Characters of benchmark text that a task holds in memory at a time.
BLOCK = 8_000_000
#: Bits of a pair's hash by which pairs are counted and looked up first: tables of a fixed size.
SLOT_BITS = 22
#: Words of a text that are looked up at a time, and cells of a row of alignments computed together.
_WORDS, _CELLS = 1 << 20, 1 << 19
#: Bytes that separate words: ASCII other than letters and digits.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of lower-cased texts; letters beyond ASCII have their case folded too."""
    return B.text_column(pc.utf8_lower(column))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each lower-cased word, and the rows' bounds (n + 1)."""
    start, end, row = B.words(raw, offsets, GAP)
    h = B.xxh64(B.LOWER[raw], start, end - start)
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))])


def hashed_rows(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, word hashes, bounds); a very long row is a run, hashed by parts."""
    for i, j in B.pieces(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j == i + 1:
            parts = [word_hashes(p, np.array([0, len(p)]))[0] for p in B.cuts(part, GAP)]
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield i, h, np.array([0, len(h)])
        else:
            yield i, *word_hashes(part, at)


def pairs(h: np.ndarray, step: int) -> np.ndarray:
    """Hash of each word with the one ``step`` after it."""
    with np.errstate(over="ignore"):
        return (B._rotl(h[:-step], 23) + h[step:]) * B.PRIME[1]


def _single(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return B._rotl(h, 41) * B.PRIME[2]


def _slot(gram: np.ndarray) -> np.ndarray:
    return gram >> np.uint64(64 - SLOT_BITS)


def _owned(gram: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A pair's hash mixed with the item it belongs to."""
    with np.errstate(over="ignore"):
        return (gram ^ (item.astype(np.uint64) * B.PRIME[0])) * B.PRIME[3]


def grams(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word (in ``h``) and row of each pair of words up to two apart within a row."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found, at = [], []
    for step in (1, 2):
        own = np.flatnonzero(row[:-step] == row[step:]) if len(h) > step else np.zeros(0, np.int64)
        found.append(pairs(h, step)[own] if len(own) else np.zeros(0, np.uint64))
        at.append(own)
    both = np.concatenate(at)
    return np.concatenate(found), both, row[both]


@dataclass
class Items:
    """A block of benchmark items: ids, words as hashes, what each needs, seeds, and all pairs.

    ``need`` is the number of near pairs an alignment that counts has at least; an item of one or
    two words must stand whole.
    """

    ids: list
    words: np.ndarray
    bounds: np.ndarray
    need: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    at: np.ndarray
    owned: np.ndarray

    @staticmethod
    def of(ids: list, texts: pa.Array, count: np.ndarray, least: float) -> Items:
        """``count`` tells how often pairs of each slot stand in the documents."""
        parts = [(h, np.diff(bounds)) for _, h, bounds in hashed_rows(*_folded(texts))]
        words = np.concatenate([h for h, _ in parts] or [np.zeros(0, np.uint64)])
        n = np.concatenate([k for _, k in parts] or [np.zeros(0, np.int64)])
        bounds = np.concatenate([[0], np.cumsum(n)])
        gram, place, item = grams(words, bounds)
        at = place - bounds[item]
        short = n <= 2
        need = np.where(short, 0, np.maximum(np.ceil(least * n - 1 - 1e-9), 1)).astype(np.int64)
        # How often the pairs that begin at a word stand in the documents; ties go to the earlier word.
        often = np.full(len(words), -1, np.int64)
        np.maximum.at(often, place, count[_slot(gram)])
        row = np.repeat(np.arange(len(n)), n)
        begins = np.flatnonzero(often >= 0)
        order = begins[np.lexsort((begins, often[begins], row[begins]))]
        rank = np.zeros(len(words), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(row[order], row[order], "left")
        seed = (rank[place] < n[item] - need[item]) & ~short[item]
        pair = np.flatnonzero(short[item] & (at == 0))
        alone = np.flatnonzero(n[row] == 1)
        keys = np.concatenate([gram[seed], gram[pair], _single(words[alone])])
        of = np.concatenate([item[seed], item[pair], row[alone]])
        where = np.concatenate([at[seed], at[pair], np.zeros(len(alone), np.int64)])
        by = np.argsort(keys, kind="stable")
        score = np.where(short, HIT * n, np.ceil(least * HIT * n - 1e-9)).astype(np.int64)
        return Items(ids, words, bounds, need, score, keys[by], of[by], where[by], np.unique(_owned(gram, item)))

    @cached_property
    def live(self) -> np.ndarray:
        """Whether a slot holds a seed."""
        t = np.zeros(1 << SLOT_BITS, bool)
        t[_slot(self.keys)] = True
        return t

    @cached_property
    def singles(self) -> bool:
        return bool((np.diff(self.bounds) == 1).any())

    def seeds_in(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and diagonal (first word less its place in the item) of each seed found."""
        rows, items, diagonals = [], [], []
        for lo in range(0, len(h), _WORDS):
            hi = min(len(h), lo + _WORDS)
            part = h[lo : hi + 2]
            for step in (0, 1, 2):
                if step == 0 and not self.singles or len(part) <= step:
                    continue
                gram = (_single(part) if step == 0 else pairs(part, step))[: hi - lo]
                hit = np.flatnonzero(self.live[_slot(gram)])
                a, b = np.searchsorted(self.keys, gram[hit], "left"), np.searchsorted(self.keys, gram[hit], "right")
                each = np.repeat(lo + hit, b - a)
                seed = np.repeat(a, b - a) + np.arange(len(each)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
                row = np.searchsorted(bounds, each, "right") - 1
                inside = each + step < bounds[row + 1]
                if step == 2:
                    inside &= np.diff(self.bounds)[self.item[seed]] > 2
                rows.append(row[inside])
                items.append(self.item[seed[inside]])
                diagonals.append((each - bounds[row])[inside] - self.at[seed[inside]])
        if not rows:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(rows), np.concatenate(items), np.concatenate(diagonals)


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and where in the text it ends (exclusive)."""
    score, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda k: (len(texts[k]), len(items[k])))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(texts[order[hi]]) <= _CELLS:
            hi += 1
        own, lo = order[lo:hi], hi
        long, wide = max(len(items[k]) for k in own), max(len(texts[k]) for k in own)
        a, b = np.zeros((len(own), long), np.uint64), np.zeros((len(own), wide), np.uint64)
        in_a, in_b = np.zeros((len(own), long), bool), np.zeros((len(own), wide), bool)
        for r, k in enumerate(own):
            a[r, : len(items[k])], in_a[r, : len(items[k])] = items[k], True
            b[r, : len(texts[k])], in_b[r, : len(texts[k])] = texts[k], True
        h = np.zeros((len(own), wide + 1), np.int32)
        ramp = (np.arange(wide + 1) * -SKIP).astype(np.int32)
        best, where = np.zeros(len(own), np.int32), np.zeros(len(own), np.int64)
        for i in range(long):
            same = (a[:, i : i + 1] == b) & in_a[:, i : i + 1] & in_b
            now = np.maximum(h + SKIP, 0)
            now[:, 1:] = np.maximum(now[:, 1:], h[:, :-1] + np.where(same, HIT, MISS).astype(np.int32))
            now[:, 0] = 0
            # Gaps in the item: a cell reaches those to its right at SKIP each.
            h = np.maximum.accumulate(now + ramp, axis=1) - ramp
            top = h.argmax(axis=1)
            value = h[np.arange(len(own)), top]
            better = value > best
            best[better], where[better] = value[better], top[better]
        score[own], end[own] = best, where
    return score, end


def _passages(h: np.ndarray, bounds: np.ndarray, items: Items, least: float) -> tuple[np.ndarray, ...]:
    """Row, item, first and last word (exclusive) of each stretch that can hold an alignment that counts."""
    row, item, diagonal = items.seeds_in(h, bounds)
    n = np.diff(items.bounds)[item]
    # An alignment that counts has at most so many errors, and drifts no further from its seed.
    slack = np.floor(2 * n * (1 - least) + 1e-9).astype(np.int64)
    order = np.lexsort((diagonal, item, row))
    row, item, n, first = row[order], item[order], n[order], (diagonal - slack)[order]
    last = first + n + 2 * slack[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (first[1:] > last[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row))[: len(head)] - 1
    row, item = row[head], item[head]
    size = np.diff(bounds)[row]
    return row, item, np.maximum(first[head], 0), np.minimum(last[tail], size)


def _near(h: np.ndarray, bounds: np.ndarray, items: Items, found: tuple[np.ndarray, ...]) -> np.ndarray:
    """Words of each stretch that begin a pair of its item."""
    row, item, first, last = found
    size = last - first
    of = np.repeat(np.arange(len(row)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + (bounds[row] + first)[of]
    stop, hit = (bounds[row] + last)[of], np.zeros(len(of), bool)
    if len(items.owned):
        for step in (1, 2):
            on = np.flatnonzero(at + step < stop)
            with np.errstate(over="ignore"):
                gram = (B._rotl(h[at[on]], 23) + h[at[on] + step]) * B.PRIME[1]
            key = _owned(gram, item[of[on]])
            k = np.minimum(np.searchsorted(items.owned, key), len(items.owned) - 1)
            hit[on] |= items.owned[k] == key
    return np.bincount(of, hit, minlength=len(row))


def find(h: np.ndarray, bounds: np.ndarray, items: Items, least: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, last word) of the best passage of each row for each item."""
    found = _passages(h, bounds, items, least)
    if not len(found[0]):
        return []
    some, step = [], 1 << 12
    for lo in range(0, len(found[0]), step):
        part = tuple(x[lo : lo + step] for x in found)
        some.append(lo + np.flatnonzero(_near(h, bounds, items, part) >= items.need[part[1]]))
    row, item, first, last = (x[np.concatenate(some)] for x in found)
    own = [items.words[items.bounds[i] : items.bounds[i + 1]] for i in item]
    text = [h[bounds[r] + a : bounds[r] + b] for r, a, b in zip(row, first, last, strict=True)]
    score, end = align(own, text)
    good = np.flatnonzero(score >= items.least[item])
    # The same alignment backwards from its end shows where it begins.
    _, back = align([own[k][::-1] for k in good], [text[k][: end[k]][::-1] for k in good])
    best: dict[tuple[int, int], tuple] = {}
    for k, reach in zip(good.tolist(), back.tolist(), strict=True):
        r, i, a = int(row[k]), int(item[k]), int(first[k])
        got = (float(score[k]) / (HIT * len(own[k])), -(a + int(end[k]) - reach), -(a + int(end[k]) - 1))
        best[r, i] = max(best.get((r, i), got), got)
    return [(r, i, s, -a, -b) for (r, i), (s, a, b) in best.items()]


def _counts(docs: DataFrame, benchmark: DataFrame) -> np.ndarray:
    """How often pairs of each slot that the benchmark has stand in the documents, in one pass."""
    spark = docs.sparkSession
    wanted = np.zeros(1 << SLOT_BITS, bool)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << SLOT_BITS, bool)
        for batch in batches:
            for _, h, bounds in hashed_rows(*_folded(batch.column(0))):
                own[_slot(grams(h, bounds)[0])] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(own).astype(np.int32))], names=["slot"])

    # One row a slot at most, 4 million; so below.
    got = benchmark.select("text").mapInArrow(slots, "slot int").distinct().toArrow()
    wanted[got["slot"].to_numpy()] = True
    sent = spark.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, seen = sent.value, np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, h, _bounds in hashed_rows(*_folded(batch.column(0))):
                for lo in range(0, len(h), _WORDS):
                    for step in (1, 2):
                        slot = _slot(pairs(h[lo : lo + _WORDS + step], step)) if len(h) > lo + step else np.zeros(0, np.uint64)
                        np.add.at(seen, slot[live[slot]].astype(np.int64), 1)
        on = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(seen[on])], names=["slot", "n"])

    seen = np.zeros(1 << SLOT_BITS, np.int64)
    if len(got):
        found = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
        seen[found["slot"].to_numpy()] = found["n"].to_numpy()
    return seen


def _blocks(spark: SparkSession, benchmark: DataFrame, count: np.ndarray, least: float, block: int) -> list[str]:
    """Write the benchmark as blocks of about ``block`` characters; their files in the shared folder."""
    total = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-int(total) // block))
    out = full_uri(spark, fresh_path(spark, "benchmark"))
    store, path = store_of(out)
    store.create_dir(path, recursive=True)
    sent = spark.sparkContext.broadcast(count)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts.append(batch.column(1))
        if not ids:
            return
        file = f"{out}/{uuid.uuid4().hex}"
        made = Items.of(ids, pa.chunked_array(texts).combine_chunks(), sent.value, least)
        if not len(made.words):
            return
        store, path = store_of(file)
        with store.open_output_stream(path) as f:
            f.write(pickle.dumps(made, pickle.HIGHEST_PROTOCOL))
        yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])

    # One row a block comes back; a task that runs twice leaves a file that nothing names.
    rows = benchmark.repartition(n, F.xxhash64("id", "text")) if n > 1 else benchmark.coalesce(1)
    return [r["file"] for r in rows.select("id", "text").mapInArrow(build, "file string").collect()]


#: Words of documents that a task holds while block after block is loaded, 8 bytes each beside the texts.
HELD = 1 << 24


def _held(batches: Iterator[pa.RecordBatch], column: int, most: int = HELD) -> Iterator[list[tuple[pa.RecordBatch, list]]]:
    """Batches with their hashed rows, as many at once as have ``most`` words or one alone has more, so that a task loads each block once or a few times."""
    group, words = [], 0
    for batch in batches:
        hashed = list(hashed_rows(*_folded(batch.column(column))))
        n = sum(len(h) for _, h, _ in hashed)
        if group and words + n > most:
            yield group
            group, words = [], 0
        group.append((batch, hashed))
        words += n
    if group:
        yield group


_LOADED: dict[str, Items] = {}


def _load(file: str) -> Items:
    """A block; a worker keeps the one it used last."""
    if file not in _LOADED:
        _LOADED.clear()
        store, path = store_of(file)
        with store.open_input_stream(path) as f:
            _LOADED[file] = pickle.loads(f.readall())
    return _LOADED[file]


def _prepared(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, least: float, block: int) -> list[str]:
    own = docs.select(F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    return _blocks(docs.sparkSession, items, _counts(own, items), least, block)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", least: float = SCORE, block: int = BLOCK,
) -> DataFrame:
    """Rows (id, item, score, first_word, last_word): passages of ``docs`` that copy an item.

    Words are runs of ASCII letters, digits and other characters, lower-cased; an alignment gains
    two a common word and loses one a changed, added or left-out word. ``score`` is the best
    alignment's share of the item's perfect score. Every row and item whose best alignment reaches
    ``least`` (over 0, 1 at most) are told; an item of one or two words must stand whole. Of several
    passages for an item the best is told, and of equals the first.

    Null and blank texts match nothing, nor do null and blank items. Null ids are told as null;
    repeated rows each give rows; repeated items give rows of their own. Other columns aren't read.
    Either table empty: no rows. Documents are read twice, whatever the benchmark's size.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    files = _prepared(docs, text_col, benchmark, item_col, item_text, least, block)
    types = [pa.float64(), pa.int64(), pa.int64()]
    item_type = pa.schema(benchmark.select(item_col).limit(0).toArrow().schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _held(batches, 1):
            for file in files:
                items = _load(file)
                for batch, i, h, bounds in ((batch, *part) for batch, hashed in group for part in hashed):
                    got = find(h, bounds, items, least)
                    row = pa.array([i + g[0] for g in got], pa.int64())
                    names = pa.array([items.ids[g[1]] for g in got], item_type)
                    rest = [pa.array([g[k] for g in got], t) for k, t in enumerate(types, 2)]
                    if got:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), names, *rest], names=["id", "item", "score", "first_word", "last_word"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, item {item_kind}, score double, first_word long, last_word long")
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SCORE, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` for which ``contaminated`` tells no item; columns stay as they are.

    Nulls, repeats and empty tables are as there: what isn't a match stays.
    """
    at = docs.columns.index(text_col)
    files = _prepared(docs, text_col, benchmark, item_col, item_text, least, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _held(batches, at):
            clean = [np.ones(batch.num_rows, bool) for batch, _ in group]
            for file in files:
                items = _load(file)
                for k, (_, hashed) in enumerate(group):
                    for i, h, bounds in hashed:
                        clean[k][[i + g[0] for g in find(h, bounds, items, least)]] = False
            for (batch, _), keep in zip(group, clean, strict=True):
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
