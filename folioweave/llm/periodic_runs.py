"""Runs of periodically repeated words: Lyndon words under two orders, extended by rolling-hash LCE.

A run of period p holds, under one of two opposite orders of the words, a Lyndon word of length p
that is the longest one from its place on. A stack scanned from right to left yields the longest
Lyndon word of every place: it ends where the next smaller suffix begins. Suffixes are compared by
their first words, ties by the length of their longest common extension (LCE), found by binary search
over rolling hashes. Each such word is extended to both sides in the same way, and the words of every
run found are compared one by one with those a period on. No suffix array is built; a document takes
time in proportion to its words, times a logarithm where they repeat.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewise as B

#: Words of a run at least, as long as it holds two periods.
LEAST = 12
#: Words of a suffix that are compared one by one before hashes are.
DIRECT = 4
#: Words up to the last tie at the same distance that are compared one by one to carry on its length.
NEAR = 32
#: Modulus of the rolling hash, and its bases; another one is taken should words show that hashes collided.
MODULUS, BASES = 2**61 - 1, (0x1F3A9C5B7D2E4861, 0x0B4D17E9A35C6F23, 0x16C8E27F90A1B3D5)
#: Words from which on they are kept in compact arrays in place of lists.
MANY = 1 << 20


class _Numbers(dict):
    """A number for each word, in the order of their first places."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def numbered(raw: np.ndarray, most: int = 1 << 20) -> array:
    """A number for each word of a text, equal for equal words; parts of ``most`` bytes are split at a time."""
    number, out = _Numbers(), array("q")
    for part in B.cuts(raw, most=most):
        out.extend(map(number.__getitem__, part.tobytes().split()))
    return out


def extension(word: Sequence[int], base: int) -> tuple[Callable[[int, int], int], Callable[[int, int], int]]:
    """Two functions of places a < b: how many words agree from them on, and how many before them.

    The rolling hashes are made when the first pair agrees in more than ``DIRECT`` words.
    """
    n, made = len(word), []

    def hashes() -> tuple[array, array]:
        if not made:
            made.append(array("Q", accumulate(word, lambda h, x: (h * base + x) % MODULUS, initial=0)))
            made.append(array("Q", accumulate(range(n), lambda h, _: h * base % MODULUS, initial=1)))
        return made[0], made[1]

    def after(a: int, b: int) -> int:
        most, k = n - b, 0
        while k < DIRECT:
            if k == most or word[a + k] != word[b + k]:
                return k
            k += 1
        h, power = hashes()
        step = DIRECT
        while k + step <= most and (h[a + k + step] - h[b + k + step] - (h[a + k] - h[b + k]) * power[step]) % MODULUS == 0:
            k, step = k + step, 2 * step
        while step := step >> 1:
            if k + step <= most and (h[a + k + step] - h[b + k + step] - (h[a + k] - h[b + k]) * power[step]) % MODULUS == 0:
                k += step
        return k

    def before(a: int, b: int) -> int:
        most, k = a, 0
        while k < DIRECT:
            if k == most or word[a - k - 1] != word[b - k - 1]:
                return k
            k += 1
        h, power = hashes()
        step = DIRECT
        while k + step <= most and (h[a - k] - h[b - k] - (h[a - k - step] - h[b - k - step]) * power[step]) % MODULUS == 0:
            k, step = k + step, 2 * step
        while step := step >> 1:
            if k + step <= most and (h[a - k] - h[b - k] - (h[a - k - step] - h[b - k - step]) * power[step]) % MODULUS == 0:
                k += step
        return k

    return after, before


def next_smaller(word: Sequence[int], after: Callable[[int, int], int]) -> array | list[int]:
    """For each place the next one whose suffix is smaller, the end if none is; a suffix that ends first is smaller.

    The places that a chain of these leads through are the stack of the scan from right to left.
    """
    n = len(word)
    end = [n] * n if n < MANY else array("q", [n]) * n
    # The last tie: its place, the other suffix's distance, and what they had in common.
    tied = far = common = 0
    for i in range(n - 2, -1, -1):
        own, j = word[i], i + 1
        while j < n:
            other = word[j]
            if own > other:
                break
            if own == other:
                k = 1
                if j - i == far and tied - i <= NEAR:
                    while i + k < tied and word[i + k] == word[j + k]:
                        k += 1
                    if i + k == tied:
                        k += common
                else:
                    k = after(i, j)
                tied, far, common = i, j - i, k
                if j + k == n or word[i + k] > word[j + k]:
                    break
            j = end[j]
        end[i] = j
    return end


def _likely(w: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """Places whose Lyndon word may extend to a run: a run's words beyond one period, half of ``least`` at least, lie on its two sides."""
    n = len(w)
    place = np.flatnonzero(end < n)
    right, left = place[end[place] - place <= n // 2], None
    left = right
    for k in range(max(1, min(3, -(-least // 4)))):
        right = right[end[right] + k < n]
        right = right[w[right + k] == w[end[right] + k]]
        left = left[left - k - 1 >= 0]
        left = left[w[left - k - 1] == w[end[left] - k - 1]]
    return np.union1d(left, right)


def find_runs(word: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of ``least`` words and two periods or more, by start, then period.

    A run is a stretch of words that are equal to those one period on, cannot be extended and has no smaller
    period. ``word`` holds positive numbers.
    """
    n = len(word)
    if n < least:
        return []
    w = np.frombuffer(word if isinstance(word, array) else array("q", word), np.int64)
    for base in BASES:
        found, sure = set(), True
        for order in (w, -w):
            seq = order.tolist() if n < MANY else array("q", order.tobytes())
            after, before = extension(seq if order is w else w.tolist() if n < MANY else word, base)
            end = np.asarray(next_smaller(seq, after), dtype=np.int64)
            last: dict[int, tuple[int, int]] = {}
            for i in _likely(w, end, least).tolist():
                j = int(end[i])
                p = j - i
                start, stop = last.get(p, (n, 0))
                if start <= i and j <= stop:
                    continue
                last[p] = start, stop = i - before(i, j), j + after(i, j)
                if stop - start >= max(least, 2 * p):
                    found.add((start, stop - start, p))
        for start, length, p in found:
            stop = start + length
            sure &= bool((w[start : stop - p] == w[start + p : stop]).all())
            sure &= (start == 0 or w[start - 1] != w[start + p - 1]) and (stop == n or w[stop] != w[stop - p])
        if sure:
            return sorted(found, key=lambda run: (run[0], run[2]))
    raise ArithmeticError("hashes of all bases collided")


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def collapse(raw: np.ndarray, drop: np.ndarray, most: int = 1 << 20) -> bytes:
    """The words of a text that aren't in ``drop``, joined by one space."""
    out, at = [], 0
    for part in B.cuts(raw, most=most):
        words = part.tobytes().split()
        if kept := b" ".join(compress(words, (~drop[at : at + len(words)]).tolist())):
            out.append(kept)
        at += len(words)
    return b" ".join(out)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row (id, n_words, runs, collapsed) for each row of ``docs``.

    Words are runs of bytes other than ASCII white space, numbered from 0 and compared as they are.
    ``runs`` lists (start, length, period) of every run of ``least`` words and two periods or more, by
    start, then period; ``collapsed`` is the text without the words that any run holds after its first
    period, the others joined by one space.

    A null or blank text has no words, no runs and an empty ``collapsed``. Null and repeated ids each
    give a row; ids aren't looked at. Other columns of ``docs`` are neither read nor returned. An empty
    table gives an empty result. Texts are worked on whole, one at a time, in about 60 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = B.text_column(batch.column(1))
            for i, j in B.pieces(offsets):
                size, at, spans, texts = [], [0], [], []
                for k in range(i, j):
                    text = raw[offsets[k] : offsets[k + 1]]
                    word = numbered(text)
                    found = find_runs(word, least)
                    size.append(len(word))
                    spans += found
                    at.append(len(spans))
                    texts.append(collapse(text, repeated(len(word), found)))
                columns = np.array(spans, np.int64).reshape(-1, 3)
                struct = pa.StructArray.from_arrays([pa.array(columns[:, c]) for c in range(3)], names=["start", "length", "period"])
                out = [batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), struct), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text) where the end of a tenth of the texts is a loop of its own words.

    Let h be the CRC-32 of the decimal id and g = h // 10. Where h % 10 is 0 and a text has n > 0 words, word
    i >= a becomes word a + (i - a) % p, for a = g % n and p = 1 + (n - a) // (3 + g % 8). Null ids and texts
    stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        block = F.slice(words, a + 1, p)
        tail = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when((h % 10 == 0) & F.col(text_col).isNotNull(), F.transform(F.array(words), looped)[0]).otherwise(F.col(text_col))
    return docs.select(F.col(id_col), text.alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From ``periodic_runs``: the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        id_col, "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
