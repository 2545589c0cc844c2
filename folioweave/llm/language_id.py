"""Language identification by bit-sliced Bloom filters of byte n-grams.

Slot ``i`` of the table is a bit mask of languages, of as many words as they need: bit ``l`` is bit
``i`` of language ``l``'s Bloom filter. One look-up of an n-gram, the AND of its slots, gives the mask of all languages that hold
it. Per document the n-grams of each language are counted, and the share is corrected for the
filter's false positives, which follow from how full each language's bit slice is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import hash_bound

GRAM = 4
#: Labelled rows that are learnt from, about, for each language: those of the smallest hashes of their id.
SAMPLE = 1500
#: An n-gram belongs to a language from so many occurrences in its sample on, and if its frequency
#: there is at least this share of its frequency in the language that uses it most.
LEAST, SHARE = 3, 0.2
SLOTS_LOG2, HASHES = 21, 3
#: Languages up to which their sampling bounds are broadcast.
FEW = 10_000
#: Bytes of a very long text that are looked up at a time.
RUN = 1 << 20
#: A text is rejected where its best language explains less than this corrected share of n-grams.
COVER = 0.25
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _fold() -> np.ndarray:
    """ASCII letters lower-cased, other ASCII bytes a space, bytes of other characters kept."""
    t = np.full(256, 0x20, np.uint8)
    t[128:] = np.arange(128, 256)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


FOLD = _fold()
_BLANK = int.from_bytes(b" " * GRAM, "little")


def byte_grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of each row, set between spaces; their row bounds (n + 1); which aren't blank."""
    rows = len(offsets) - 1
    buf = np.full(len(raw) + rows + 1 + GRAM, 0x20, np.uint8)
    size = np.diff(offsets)
    if len(raw):
        buf[np.arange(len(raw)) + np.repeat(np.arange(1, rows + 1), size)] = FOLD[raw]
    grams = np.ndarray((len(raw) + rows + 1,), "<u4", buf, strides=(1,))
    # A row's grams begin at the space before it and end with the space after it.
    count = np.maximum(size + 3 - GRAM, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    first = offsets[:-1] + np.arange(rows)
    got = grams[np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], count)]
    return got, bounds, got != _BLANK


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    g = grams.astype(np.uint64)
    with np.errstate(over="ignore"):
        return [((g + np.uint64(1)) * m) >> np.uint64(64 - SLOTS_LOG2) for m in _MIX[:HASHES]]


def _letters() -> np.ndarray:
    t = np.zeros(256, bool)
    t[65:91] = t[97:123] = True
    return t


_LETTER = _letters()


def gram_runs(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, n-grams, bounds, which aren't blank); a very long text comes in several runs."""
    for i, j in B.pieces(offsets):
        part = raw[offsets[i] : offsets[j]]
        if j > i + 1 or len(part) <= RUN:
            yield i, *byte_grams(part, offsets[i : j + 1] - offsets[i])
            continue
        buf = np.concatenate([[np.uint8(0x20)], FOLD[part], [np.uint8(0x20)]])
        for lo in range(0, len(buf) - GRAM + 1, RUN):
            own = np.ascontiguousarray(buf[lo : lo + RUN + GRAM - 1])
            grams = np.ndarray((len(own) - GRAM + 1,), "<u4", own, strides=(1,))
            yield i, grams, np.array([0, len(grams)]), grams != _BLANK


@dataclass
class LanguageModel:
    """``table`` has a row for each word of a slot's mask."""

    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray
    prior: int

    def shares(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each language's corrected share of each row's n-grams (languages by rows)."""
        rows, width = len(offsets) - 1, self.table.dtype.itemsize * 8
        total, held = np.zeros(rows, np.int64), np.zeros((len(self.languages), rows), np.int64)
        for i, grams, bounds, live in gram_runs(raw, offsets):
            own, slots = slice(i, i + len(bounds) - 1), _slots(grams)
            upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[bounds]) if len(bounds) > 2 else np.count_nonzero(x)
            total[own] += upto(live)
            for word, part in enumerate(self.table):
                mask = part[slots[0]]
                for s in slots[1:]:
                    mask &= part[s]
                for k in range(word * width, min(len(self.languages), (word + 1) * width)):
                    held[k, own] += upto(((mask >> part.dtype.type(k - word * width)) & part.dtype.type(1)).astype(bool) & live)
        false = self.false_positive[:, None]
        return np.maximum(held / np.maximum(total, 1) - false, 0) / (1 - false)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its corrected share of n-grams and the second best's."""
        share = self.shares(raw, offsets)
        rows = np.arange(share.shape[1])
        best = np.where(share.max(axis=0) > 0, share.argmax(axis=0), self.prior)
        top = share[best, rows]
        rest = share.copy()
        rest[share.argmax(axis=0), rows] = -1
        return best, top, np.maximum(rest.max(axis=0), 0)


def build(languages: list[str], code: np.ndarray, gram: np.ndarray, n: np.ndarray, rows: list[int]) -> LanguageModel:
    """The filters from how often each n-gram stands in each language's sample, and the languages' rows.

    ``languages`` ascend; ``code`` numbers the language of each count.
    """
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    width = np.dtype(kind).itemsize * 8
    table = np.zeros((-(-len(languages) // width), 1 << SLOTS_LOG2), kind)
    total = np.bincount(code, n, minlength=len(languages))
    frequency = n / total[code]
    _, of = np.unique(gram, return_inverse=True)
    most = np.zeros(int(of.max(initial=-1)) + 1)
    np.maximum.at(most, of, frequency)
    keep = (n >= LEAST) & (frequency >= SHARE * most[of])
    full = np.zeros(len(languages))
    for k in range(len(languages)):
        word, bit = divmod(k, width)
        held = np.zeros(1 << SLOTS_LOG2, bool)
        for s in _slots(gram[keep & (code == k)].astype(np.uint32)):
            held[s] = True
        table[word, held] |= kind(1 << bit)
        full[k] = held.mean()
    return LanguageModel(languages, table, full**HASHES, int(np.argmax(rows)))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """Filters learnt from about ``sample`` rows a language of ``docs``; None without any.

    The rows are those whose id's hash lies below the share of all hashes that ``sample`` is of the
    language's rows. Rows with null id, text or language teach nothing.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    # One row a language: its rows, and the hash below which its sample lies.
    limits = own.groupBy("lang").agg(F.count("*").alias("rows")).toArrow().sort_by("lang")
    if not len(limits):
        return None
    languages, rows = limits["lang"].to_pylist(), limits["rows"].to_pylist()
    bounds = [(x, k, hash_bound(min(1.0, sample / n))) for k, (x, n) in enumerate(zip(languages, rows, strict=True))]
    of = docs.sparkSession.createDataFrame(bounds, "lang string, code int, most long")
    text = own.join(F.broadcast(of) if len(bounds) <= FEW else of, "lang").where(F.xxhash64("id", F.lit("language")) <= F.col("most"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = B.text_column(batch.column(0))
            of = np.asarray(batch.column(1), np.uint64)
            for i, grams, bounds, live in gram_runs(raw, offsets):
                own = np.repeat(of[i : i + len(bounds) - 1], np.diff(bounds))
                both, n = np.unique(((own << np.uint64(32)) | grams)[live], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(n)], names=["gram", "n"])

    counted = text.select("text", "code").mapInArrow(count, "gram long, n long")
    # Bounded by the sample: n-grams seen often enough in the samples of the languages.
    got = counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).toArrow()
    if not len(got):
        return None
    both, n = got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy()
    code = (both >> np.uint64(32)).astype(np.int64)
    # Languages without an n-gram that is frequent enough aren't in the model.
    known, code = np.unique(code, return_inverse=True)
    return build([languages[k] for k in known], code, (both & np.uint64(0xFFFFFFFF)).astype(np.int64), n, [rows[k] for k in known])


def _judge(model: LanguageModel | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and corrected share for each text of a batch."""
    names, score, cover = [], [], []
    raw, offsets = B.text_column(column)
    for i, j in B.pieces(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        has = np.array([_LETTER[part[a:b]].any() for a, b in zip(at, at[1:], strict=False)])
        for k in np.flatnonzero(~has):
            own = part[at[k] : at[k + 1]]
            has[k] = any(c.isalpha() for c in own[own >= 128].tobytes().decode("utf-8", "replace"))
        if model is None:
            has[:] = False
            best, top, second = (np.zeros(j - i, np.int64), np.zeros(j - i), np.zeros(j - i))
        else:
            best, top, second = model.predict(part, at)
        names += [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)] if model else ["und"] * (j - i)
        score.append(np.where(has, np.where(top > 0, top / np.maximum(top + second, 1e-9), 1 / max(1, len(model.languages) if model else 1)), 0.0))
        cover.append(np.where(has, top, 0.0))
    none = [np.zeros(0)]
    return names, np.concatenate(score or none), np.concatenate(cover or none)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, lang_pred, score, cover) for each row of ``docs``.

    ``lang_pred`` is a language of ``model``, or ``und`` for a text that is null or has no letter (or
    without a model). ``score`` is the best language's share of its own and the second best's
    corrected counts, 0 for ``und``; ``cover`` is the corrected share of the text's n-grams that its
    language holds. Texts too short for any n-gram get the language of most labelled rows. Ties go to
    the language first in the alphabet. Repeated rows give repeated rows; other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, cover = _judge(sent.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(cover)], names=["id", "lang_pred", "score", "cover"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, cover double")
    return out.withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", cover: float = COVER) -> DataFrame:
    """Rows of ``docs`` whose text has a language that explains at least ``cover`` of its n-grams.

    Rows whose text is null, has no letter or is in no known language go; columns stay as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, share = _judge(sent.value, batch.column(at))
            yield batch.filter(pa.array((np.array(names, object) != "und") & (share >= cover)))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod)) == rest, F.lit(False))
