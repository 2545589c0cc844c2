"""NumPy over whole Arrow batches of UTF-8 text: words, XXH64 of slices, byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
# Fixed values of the XXH64 definition.
PRIME = tuple(U(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
))
#: Bytes of a slice from which hashing it alone is faster.
LONG = 2048
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer text is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def cuts(raw: np.ndarray, gap: np.ndarray = SPACE, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """A text in parts of about ``most`` bytes, each ending at a byte of ``gap`` or with the text."""
    at = 0
    while at < len(raw):
        end = at + most
        while end < len(raw):
            stop = np.flatnonzero(gap[raw[end : end + 4096]])
            if len(stop):
                end += int(stop[0])
                break
            end += 4096
        yield raw[at:end]
        at = end


def words(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside ``gap``; rows don't run together."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~gap[raw]
    first = np.zeros(len(raw), bool)
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | first[1:]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | first[1:]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(offsets, start, "right") - 1


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * PRIME[1], 31) * PRIME[0]


def xxh64(raw: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``raw[start : start + size]`` for all slices at once, very long ones one by one."""
    if len(far := np.flatnonzero(size > LONG)):
        size = size.copy()
        own = np.array([xxhash.xxh64_intdigest(raw[s : s + n].data, seed) for s, n in zip(start[far], size[far], strict=True)], U)
        size[far] = 0
        h = xxh64(raw, start, size, seed)
        h[far] = own
        return h
    buf = np.concatenate([raw, np.zeros(8, np.uint8)])
    u8 = np.ndarray((len(raw) + 1,), "<u8", buf, strides=(1,))
    u4 = np.ndarray((len(raw) + 1,), "<u4", buf, strides=(1,))
    s = U(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), s + PRIME[4], U)
        long = np.flatnonzero(size >= 32)
        if len(long):
            p, left = start[long].copy(), size[long] // 32
            v = [np.full(len(long), x, U) for x in (s + PRIME[0] + PRIME[1], s + PRIME[1], s, s - PRIME[0])]
            live = np.arange(len(long))
            while len(live):
                for k in range(4):
                    v[k][live] = _round(v[k][live], u8[p[live] + 8 * k])
                p[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                acc = (acc ^ _round(np.zeros(len(acc), U), v[k])) * PRIME[0] + PRIME[3]
            h[long] = acc
        h += size.astype(U)
        p, left = start + size // 32 * 32, size % 32
        for k in range(3):
            if len(on := np.flatnonzero(left >= 8 * (k + 1))):
                h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), U), u8[p[on] + 8 * k]), 27) * PRIME[0] + PRIME[3]
        p, left = p + left // 8 * 8, left % 8
        if len(on := np.flatnonzero(left >= 4)):
            h[on] = _rotl(h[on] ^ (u4[p[on]].astype(U) * PRIME[0]), 23) * PRIME[1] + PRIME[2]
        p, left = p + left // 4 * 4, left % 4
        for k in range(3):
            if len(on := np.flatnonzero(left > k)):
                h[on] = _rotl(h[on] ^ (buf[p[on] + k].astype(U) * PRIME[4]), 11) * PRIME[0]
        h = (h ^ (h >> U(33))) * PRIME[1]
        h = (h ^ (h >> U(29))) * PRIME[2]
        return h ^ (h >> U(32))
