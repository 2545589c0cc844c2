"""Document quality from a linear-chain conditional random field over lines.

Each line is good (1) or bad (0); a line's features stand beside those of the lines before and
after it. Labels are of documents, so the field is first fitted with every line of a document
bearing its label, then once more with the lines of bad documents relabelled by its own marginals.
A document's share of good characters, by forward-backward marginals weighted with the lines'
lengths, is turned into a probability by a logistic curve fitted on the learning rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as B
from .common import hash_bound

#: Labelled documents that are learnt from, about: those of the smallest hashes of their id; and their lines, at most.
SAMPLE, LINES = 6000, 500_000
#: Lines whose features are made at a time.
BLOCK = 1 << 16
THRESHOLD = 0.3
ROUNDS, STEP, RIDGE = 80, 0.15, 1e-3


def _is(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER = _is(bytes(range(65, 91)))
_LETTER = _UPPER | _is(bytes(range(97, 123))) | _is(bytes(range(128, 256)))
_DIGIT = _is(b"0123456789")
_STOP = _is(b".,;:?'\"()-")
_LOUD = _is(b"!?")
_MARK = ~(_LETTER | _DIGIT | _STOP | _LOUD | B.SPACE)
_END = _is(b".!?:\"")
_CLASSES = (_UPPER, _DIGIT, _STOP, _LOUD, _MARK)
N_OWN = len(_CLASSES) + 8


def _again(key: np.ndarray, group: np.ndarray | int) -> np.ndarray:
    """Whether a key stood earlier in its group; sorted by parts of about two million keys."""
    again = np.zeros(len(key), bool)
    with np.errstate(over="ignore"):
        mixed = key if isinstance(group, int) else key ^ (group.astype(np.uint64) * B.PRIME[0])
    parts = 1 + len(key) // (1 << 21)
    for k in range(parts):
        own = np.flatnonzero(mixed % np.uint64(parts) == k) if parts > 1 else np.arange(len(key))
        order = own[np.argsort(mixed[own], kind="stable")]
        again[order[1:]] = mixed[order[1:]] == mixed[order[:-1]]
    return again


class Lines:
    """The lines of a run of texts: where they are, and what of their features needs whole texts.

    A few numbers a line and a word are kept; the features themselves are made for some lines at a time.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        rows = len(offsets) - 1
        breaks = np.flatnonzero(raw == 10)
        # A row has one line more than newlines. Line starts: each row's, and the place after each newline.
        self.raw, self.per = raw, np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=rows) + 1
        self.bounds = np.concatenate([[0], np.cumsum(self.per)])
        n = int(self.bounds[-1])
        self.start, stop = np.empty(n, np.int64), np.empty(n, np.int64)
        rest = np.ones(n, bool)
        rest[self.bounds[:-1]] = False
        self.start[self.bounds[:-1]], self.start[rest] = offsets[:-1], breaks + 1
        last = np.zeros(n, bool)
        last[self.bounds[1:] - 1] = True
        stop[self.bounds[1:] - 1], stop[~last] = offsets[1:], breaks
        self.size = stop - self.start
        # Words in order, hashed by parts of the text that end at white space.
        h, line, at = [], [], 0
        for part in B.cuts(raw) if rows == 1 else ([raw] if len(raw) else []):
            ends = np.append(self.start[(self.start > at) & (self.start < at + len(part))] - at, len(part)) if rows == 1 else np.append(self.start, len(raw))
            w0, w1, own = B.words(part, np.concatenate([[0], ends]) if rows == 1 else ends)
            h.append(B.xxh64(B.LOWER[part], w0, w1 - w0))
            line.append((own + (np.searchsorted(self.start, at, "right") - 1 if rows == 1 else 0)).astype(np.int32))
            at += len(part)
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        line = np.concatenate(line) if line else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(rows), self.per) if rows > 1 else None
        count = lambda at, weight=None: np.bincount(at, weight, minlength=n).astype(np.int32)
        self.words = count(line)
        self.again = np.zeros((n, 3), np.float32)
        self.again[:, 0] = count(line, _again(h, line)) / np.maximum(self.words, 1)
        with np.errstate(over="ignore"):
            pair, at = B._rotl(h[:-1], 17) * B.PRIME[1] + h[1:], line[1:]
        if doc is not None:
            inner = doc[at] == doc[line[:-1]]
            pair, at = pair[inner], at[inner]
        del h, line
        self.again[:, 1] = count(at, _again(pair, 0 if doc is None else doc[at])) / np.maximum(count(at), 1)
        whole = np.concatenate([B.xxh64(raw, self.start[k : k + BLOCK], self.size[k : k + BLOCK]) for k in range(0, n, BLOCK)])
        self.again[:, 2] = _again(whole, 0 if doc is None else doc) * (self.size > 0)

    def _own(self, lo: int, hi: int) -> np.ndarray:
        """The lines' own features."""
        start, size, n = self.start[lo:hi], self.size[lo:hi], self.words[lo:hi]
        f, first, full = [], int(start[0]), np.flatnonzero(size > 0)
        part = self.raw[first : int(start[-1] + size[-1])]
        for t in _CLASSES:
            total = np.zeros(hi - lo)
            # Newlines are of no class, so a line's signs may be counted up to the next line that has any.
            if len(full):
                total[full] = np.add.reduceat(t[part], start[full] - first, dtype=np.int64)
            f.append(total / np.maximum(size, 1))
        f += [self.again[lo:hi, k] for k in range(3)]
        f.append(np.log1p(size) / 5)
        f.append((w := (size - n + 1) / np.maximum(n, 1)) / (w + 6))
        f.append(np.minimum(n, 12) / 12)
        end = np.zeros(hi - lo)
        end[full] = _END[self.raw[(start + size - 1)[full]]]
        f.append(end)
        row = np.searchsorted(self.bounds, np.arange(lo, hi), "right") - 1
        f.append(np.log1p(self.per)[row] / 5)
        return np.stack(f, axis=1).astype(np.float32)

    def features(self, lo: int, hi: int) -> np.ndarray:
        """Features of lines ``lo`` to ``hi``: their own, those of the lines before and after, and flags."""
        n = int(self.bounds[-1])
        wide = self._own(max(lo - 1, 0), min(hi + 1, n))
        at = lo - max(lo - 1, 0)
        own = wide[at : at + hi - lo]
        none = np.zeros((1, own.shape[1]), np.float32)
        wide = np.concatenate([none] * (lo == 0) + [wide] + [none] * (hi == n))
        before, after = wide[: hi - lo].copy(), wide[2 : 2 + hi - lo].copy()
        first, last = np.zeros(hi - lo, bool), np.zeros(hi - lo, bool)
        heads = self.bounds[:-1]
        first[heads[(heads >= lo) & (heads < hi)] - lo] = True
        tails = self.bounds[1:] - 1
        last[tails[(tails >= lo) & (tails < hi)] - lo] = True
        before[first], after[last] = 0, 0
        return np.concatenate([own, before, after, np.stack([first, last, np.ones(hi - lo)], axis=1).astype(np.float32)], axis=1)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """What the features say for each line being good."""
        n = int(self.bounds[-1])
        return np.concatenate([self.features(k, min(k + BLOCK, n)) @ weights for k in range(0, n, BLOCK)]) if n else np.zeros(0)


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes (the newline included) and each row's bounds."""
    own = Lines(raw, offsets)
    return own.features(0, int(own.bounds[-1])), own.size + 1, own.bounds


def _forward(emit: np.ndarray, move: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log odds of good over bad of each line, given its chain up to it.

    Chains are cut into segments that are stepped through side by side: once for what each makes of
    either state before it, then, with the state that does come before it, for its lines.
    """
    size = np.diff(bounds)
    step = max(32, int(np.ceil(np.sqrt(size.max(initial=1)))))
    count = -(-size // step)
    of = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][of] + k * step
    length = np.minimum(step, bounds[1:][of] - start)
    order = np.argsort(-length, kind="stable")
    live = np.searchsorted(-length[order], -np.arange(step), "left")
    head = k == 0
    came = np.zeros(len(of))
    if (count > 1).any():
        e = np.exp(move)
        p = np.tile(np.eye(2), (len(of), 1, 1))
        for t in range(step):
            on = order[: live[t]]
            x = np.clip(emit[start[on] + t], -500, 500)[:, None]
            q = p[on]
            q = q @ e
            if t == 0:
                q[head[on]] = 1
            q[:, :, 0] *= np.exp(-np.maximum(x, 0))
            q[:, :, 1] *= np.exp(np.minimum(x, 0))
            p[on] = q / q.max(axis=(1, 2), keepdims=True)
        first = np.cumsum(count) - count
        for at in range(1, int(count.max())):
            on = first[count > at] + at
            odds = np.exp(-np.abs(came[on - 1]))
            v = np.stack([np.where(came[on - 1] > 0, odds, 1), np.where(came[on - 1] > 0, 1, odds)], axis=1)
            q = np.maximum((v[:, :, None] * p[on - 1]).sum(axis=1), 1e-300)
            came[on] = np.log(q[:, 1]) - np.log(q[:, 0])
    out = np.empty(len(emit))
    for t in range(step):
        on = order[: live[t]]
        at = start[on] + t
        before = came[on] if t == 0 else out[at - 1]
        told = np.logaddexp(move[0, 1], before + move[1, 1]) - np.logaddexp(move[0, 0], before + move[1, 0])
        out[at] = emit[at] + (np.where(head[on], 0, told) if t == 0 else told)
    return out


def marginals(emit: np.ndarray, move: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected moves (2 by 2) and the sum of log partition functions.

    ``emit`` scores good against bad; ``move[a, b]`` scores a line b after a line a.
    """
    ahead = _forward(emit, move, bounds)
    # The same from each chain's end, the line's own score included as well.
    behind = _forward(emit[::-1], move.T, len(emit) - bounds[::-1])[::-1]
    good = 1 / (1 + np.exp(np.clip(emit - ahead - behind, -500, 500)))
    inner = np.ones(len(emit), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    before, here = ahead[at - 1], behind[at]
    score = np.stack([a * before + move[a, b] + b * here for a in (0, 1) for b in (0, 1)], axis=1)
    score = np.exp(score - score.max(axis=1, keepdims=True)) if len(at) else score
    moves = (score / score.sum(axis=1, keepdims=True)).sum(axis=0).reshape(2, 2) if len(at) else np.zeros((2, 2))
    z = np.logaddexp(move[0, 0], before + move[1, 0]).sum() + np.logaddexp(0, ahead[bounds[1:] - 1]).sum()
    return good, moves, float(z)


def good_lines(emit: np.ndarray, move: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """P(good) of each line alone."""
    out = _forward(emit, move, bounds)
    out += _forward(emit[::-1], move.T, len(emit) - bounds[::-1])[::-1]
    out -= emit
    return 1 / (1 + np.exp(np.clip(-out, -500, 500)))


@dataclass
class QualityModel:
    weights: np.ndarray
    move: np.ndarray
    curve: tuple[float, float]

    def share(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted share of good lines of each row."""
        own = Lines(raw, offsets)
        return weighted(good_lines(own.scores(self.weights), self.move, own.bounds), own.size + 1, own.bounds)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * self.share(raw, offsets) + b)))


def weighted(good: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * size, bounds[:-1]) / np.add.reduceat(size, bounds[:-1])


def _fit_chain(x: np.ndarray, target: np.ndarray, bounds: np.ndarray, w: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximise the field's likelihood of soft line labels by Adam steps."""
    inner = np.ones(len(x), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    both = np.stack([1 - target, target], axis=1)
    seen = both[at - 1].T @ both[at]
    first = x.T @ target
    theta = np.concatenate([w, move.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        good, moves, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), bounds)
        g = np.concatenate([first - x.T @ good, (seen - moves).ravel()]) / len(x) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit(x: np.ndarray, size: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> QualityModel:
    """The field and the curve from the lines of labelled documents."""
    x = x.astype(np.float64)
    line_label = np.repeat(label.astype(float), np.diff(bounds))
    w, move = _fit_chain(x, line_label, bounds, np.zeros(x.shape[1]), np.zeros((2, 2)))
    good, _, _ = marginals(x @ w, move, bounds)
    w, move = _fit_chain(x, np.where(line_label == 1, 1.0, good), bounds, w, move)
    s = weighted(marginals(x @ w, move, bounds)[0], size, bounds)
    # Newton's steps for a ridge logistic curve over the shares.
    t, design = np.zeros(2), np.stack([s, np.ones(len(s))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ t))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        t = t + np.linalg.solve(hess, design.T @ (label - p) - 1e-2 * t)
    return QualityModel(w, move, (float(t[0]), float(t[1])))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, lines: int = LINES) -> QualityModel | None:
    """A model from about ``sample`` labelled documents; None if there are none of a class.

    They are those whose id's hash lies below the share of all hashes that ``sample`` is of the labels,
    in order of that hash as long as they have ``lines`` lines at most. Rows with a null id or label
    teach nothing; of several labels of an id the smallest counts.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    share = min(1.0, sample / max(1, own.count()))
    # About ``sample`` rows of two numbers.
    few = own.where(F.xxhash64("id", F.lit("quality")) <= F.lit(hash_bound(share)))
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    taken = text.join(F.broadcast(few), "id").select(F.xxhash64("id", F.lit("quality")).alias("h"), "label", "text", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n"))
    taken = taken.where(F.col("n") <= lines)
    # One row a document of the sample: where its lines end in the order of hashes.
    ends = sorted((r["h"], r["n"]) for r in taken.select("h", "n").collect())
    total, last = 0, -(1 << 63)
    for h, n in ends:
        if total + n > lines:
            break
        total, last = total + n, h
    n_own = N_OWN * 3 + 3

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = B.text_column(batch.column(0))
            for i, j in B.pieces(offsets):
                x, size, bounds = line_features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts = [x[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                sizes = [size[a:b].astype(np.int64).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i).cast(pa.int32()), pa.array(parts, pa.binary()), pa.array(sizes, pa.binary())], names=["label", "x", "size"])

    got = taken.where(F.col("h") <= last).select("text", "label").mapInArrow(features, "label int, x binary, size binary").toArrow()
    label = np.array(got["label"].to_pylist(), np.int64)
    if len(set(label.tolist()) & {0, 1}) < 2:
        return None
    xs = [np.frombuffer(b, np.float32).reshape(-1, n_own) for b in got["x"].to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    return fit(np.concatenate(xs), np.concatenate([np.frombuffer(b, np.int64) for b in got["size"].to_pylist()]), bounds, label)


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, score, predicted, good_share) for each row of ``docs``.

    ``score`` is the probability of label 1 and ``predicted`` whether it reaches ``threshold``. A null
    text is an empty one and, as one empty line, has a score like others. Without a model (no
    labels of both classes) all scores are 1. Repeated rows and null ids each give a row; other
    columns aren't read, and what they are called doesn't matter. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = B.text_column(batch.column(1))
            share = [np.ones(0)]
            for i, j in B.pieces(offsets):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                share.append(sent.value.share(part, at) if sent.value else np.ones(j - i))
            s = np.concatenate(share)
            a, b = sent.value.curve if sent.value else (0.0, 50.0)
            score = 1 / (1 + np.exp(-(a * s + b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(s)], names=["id", "score", "predicted", "good_share"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int, good_share double")
    return out.withColumnRenamed("id", id_col)
