"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is compiled from a model file once, on the driver:

* normaliser: the model's table of rewritten strings, longest match first, surplus spaces left out
  where the model says so, a dummy space in front, each space to the mark ``▁``;
* pieces: a prefix tree with an arc for each piece that the model can produce, over its characters;
* byte fallback: an arc for each character without a piece, over its UTF-8 bytes;
* weights in the tropical semiring (path weights add up, the least wins). In a unigram model an arc
  weighs its piece's negative score. In a BPE model the order of merges decides, not a sum: two
  pieces may follow each other just if no merge across their border would have come first. So a
  state is a position with the piece that ended there, and the step to a next piece weighs zero or
  infinity. One state a position then has a finite weight, and the shortest path is the model's own
  segmentation.

The machine is composed with a text as the path is sought: states are positions of the text with
the last piece, arcs are walked in the tree from each position that has a finite weight.

Where no piece holds a mark after another character, texts are cut there and a worker remembers the
path of each distinct part. Models with pieces across such borders are composed with whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Distinct parts whose paths a worker remembers; beyond it the memory starts anew.
REMEMBERED = 600_000
ROWS = 400


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def _rules(charsmap: bytes) -> dict[str, str]:
    """The rewritten strings of a normaliser's table: a double array over UTF-8 bytes, then the new strings."""
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units, strings = np.frombuffer(charsmap[4 : 4 + size], "<u4").astype(np.int64), charsmap[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    found, every = {}, np.arange(1, 256)
    todo = [(offset(int(units[0])), b"")]
    while todo:
        at, key = todo.pop()
        to = at ^ every
        inside = to < len(units)
        for c in every[inside][(units[to[inside]] & 0x800000FF) == every[inside]].tolist():
            unit = int(units[at ^ c])
            below = (at ^ c) ^ offset(unit)
            if unit >> 8 & 1:
                value = int(units[below]) & 0x7FFFFFFF
                found[(key + bytes([c])).decode()] = strings[value : strings.index(b"\0", value)].decode()
            todo.append((below, key + bytes([c])))
    return found


@dataclass
class Normaliser:
    """The first of the composed machines: from a text to its marked form."""

    rules: dict[str, str]
    prefix: bool
    tidy: bool

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.rules), default=0)
        firsts = "".join(sorted({re.escape(k[0]) for k in self.rules}))
        self.starts = re.compile(f"[{firsts}]") if firsts else None

    def rewritten(self, text: str) -> str:
        """``text`` with the longest string of the table at each place rewritten."""
        if self.starts is None or (m := self.starts.search(text)) is None:
            return text
        out, at = [], 0
        while m is not None:
            k = m.start()
            out.append(text[at:k])
            for size in range(min(self.longest, len(text) - k), 0, -1):
                new = self.rules.get(text[k : k + size])
                if new is not None:
                    break
            else:
                size, new = 1, text[k]
            out.append(new)
            at = k + size
            m = self.starts.search(text, at)
        out.append(text[at:])
        return "".join(out)

    def marked(self, text: str) -> str:
        text = self.rewritten(text)
        if self.tidy:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.prefix else "") + text.replace(" ", MARK) if text else ""


@dataclass
class Transducer:
    """The compiled machine; plain data, so that it can be broadcast.

    ``tree`` has a table for each prefix of a piece, with the piece's id under "".
    """

    tree: dict
    cost: dict[int, float]
    halves: dict[int, tuple[int, int]]
    joined: dict[tuple[int, int], int]
    rank: dict[int, int]
    text: list[bytes]
    byte: list[int] | None
    unknown: int
    bpe: bool
    normal: Normaliser
    cuttable: bool
    runs: dict[int, int]
    inner: set[str]
    closing: set[str] = field(default_factory=set)
    _pairs: dict[tuple[int, int], bool] = field(default_factory=dict)

    def _follows(self, a: int, b: int) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes before theirs are done.

        Both pieces are taken apart at the border, the later merge first. A merge of the two parts
        found there would win if it ranks before the merge that takes the left part in, or not
        after the one that takes the right part in (of equals the one further left comes first).
        """
        known = self._pairs.get((a, b))
        if known is not None:
            return known
        if len(self._pairs) > REMEMBERED:
            self._pairs.clear()
        x, y, over_x, over_y, fine = a, b, math.inf, math.inf, True
        while True:
            r = self.joined.get((x, y))
            if r is not None and r < over_x and r <= over_y:
                fine = False
                break
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                over_x, x = rx, self.halves[x][1]
            else:
                over_y, y = ry, self.halves[y][0]
        self._pairs[a, b] = fine
        return fine

    def path(self, text: str) -> list[int]:
        """Pieces of the shortest path over ``text``; -1 - c for a character c without a piece."""
        n, tree, bpe, cost, pairs, inf = len(text), self.tree, self.bpe, self.cost, self._pairs.get, math.inf
        weight, last, back = [inf] * (n + 1), [None] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        for start in range(n):
            here = weight[start]
            if here == inf:
                continue
            before, node, end, bare = last[start], tree, start, True
            while True:
                node = node.get(text[end]) if end < n else None
                end += 1
                if node is None:
                    if not bare:
                        break
                    # No piece is this character alone.
                    end, piece = start + 1, -1 - ord(text[start])
                else:
                    piece = node.get("")
                    if piece is None:
                        continue
                    bare = bare and end > start + 1
                if not bpe:
                    total = here + (cost[piece] if piece >= 0 else cost[self.unknown])
                elif weight[end] == inf:
                    fine = True if before is None else pairs((before, piece))
                    total = 0.0 if fine or fine is None and self._follows(before, piece) else inf
                else:
                    total = inf
                if total < weight[end]:
                    weight[end], last[end], back[end] = total, piece, start
                if node is None:
                    break
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _spell(self, path: list[int]) -> list[int]:
        out: list[int] = []
        for piece in path:
            if piece >= 0:
                out.append(piece)
            elif self.byte:
                out += [self.byte[b] for b in chr(-1 - piece).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def part(self, text: str) -> list[int]:
        """Ids of a part: marks, then other characters.

        Pieces of marks only rank equally, so of the merges among them the leftmost comes first.
        """
        marks = len(text) - len(text.lstrip(MARK))
        if marks <= 1 or not self.bpe or 1 not in self.runs:
            return self._spell(self.path(text))
        rest = self.path(text[marks - 1 :]) if marks < len(text) else []
        free = marks - 1
        if not rest or rest[0] == self.runs[1]:
            free, rest = marks, rest[1:]
        sizes: list[int] = []
        for _ in range(free):
            sizes.append(1)
            while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.runs:
                sizes[-2:] = [sizes[-2] + sizes[-1]]
        return [self.runs[n] for n in sizes] + self._spell(rest)

    def decode(self, ids: np.ndarray) -> bytes:
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return raw[1:] if (self.normal.prefix or self.normal.tidy) and raw[:1] == b" " else raw


def _tree(pieces: dict[str, int]) -> dict:
    root: dict = {}
    for s, i in pieces.items():
        node = root
        for c in s:
            node = node.setdefault(c, {})
        node[""] = i
    return root


def compile_model(path: str) -> Transducer:
    """The transducer of a model file of BPE or unigram type, read on the driver."""
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    trainer = dict(_fields(next((v for k, v in message if k == 2), b"")))
    normal = dict(_fields(next((v for k, v in message if k == 3), b"")))
    bpe = trainer.get(3, 1) == 2
    if trainer.get(3, 1) > 2 or trainer.get(24, 0) or not normal.get(5, 1):
        raise ValueError("only BPE and unigram models that mark spaces in front of words can be compiled")
    strings, scores, kinds = [], [], []
    for k, v in message:
        if k == 1:
            own = dict(_fields(v))
            strings.append(own.get(1, b"").decode())
            scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
            kinds.append(own.get(3, 1))
    if bpe and {4, 5} & set(kinds):
        raise ValueError("user-defined and unused pieces of BPE models can't be compiled")
    ids = {s: i for i, (s, k) in enumerate(zip(strings, kinds, strict=True)) if k in (1, 4)}
    byte = [-1] * 256
    text = []
    for i, (s, k) in enumerate(zip(strings, kinds, strict=True)):
        if k == 6:
            byte[int(s[1:-1], 16)] = i
            text.append(bytes([int(s[1:-1], 16)]))
        else:
            text.append(b"" if k == 3 else " ⁇ ".encode() if k == 2 else s.replace(MARK, " ").encode())
    unknown = kinds.index(2)
    plain = [scores[i] for i, k in enumerate(kinds) if k == 1] or [0.0]
    # A user-defined piece outweighs any other way to spell it.
    cost = {i: 0.1 - len(s.encode()) * max(plain) if kinds[i] == 4 else -scores[i] for s, i in ids.items()}
    joins = {b for s in ids for a, b in zip(s, s[1:], strict=False) if a.isalpha()}
    machine = Transducer(
        tree={}, cost=cost | {unknown: 10 - min(plain)}, halves={}, joined={}, rank={}, text=text,
        byte=byte if min(byte) >= 0 else None, unknown=unknown, bpe=bpe, normal=Normaliser(_rules(normal.get(2, b"")), bool(normal.get(3, 1)), bool(normal.get(4, 1))),
        cuttable=not any(MARK in s.lstrip(MARK) for s in ids), runs={}, inner={c for s in ids if len(s) > 1 for c in s}, closing=set(".,;:!?") - joins,
    )
    if not bpe:
        machine.tree = _tree(ids)
        return machine
    machine.runs = {len(s): i for s, i in ids.items() if not s.strip(MARK)}
    order = sorted((i for s, i in ids.items() if len(s) > 1), key=lambda i: -scores[i])
    machine.rank = {i: r for r, i in enumerate(order)}
    arcs = {s: i for s, i in ids.items() if len(s) == 1}
    for s, i in ids.items():
        for k in range(1, len(s)):
            if (a := ids.get(s[:k])) is not None and (b := ids.get(s[k:])) is not None:
                machine.joined[a, b] = machine.rank[i]
    # From short to long: a piece can be produced if its merges alone lead to it.
    for s, i in sorted(ids.items(), key=lambda x: len(x[0])):
        if len(s) == 1:
            continue
        pieces = [ids.get(c, -1 - ord(c)) for c in s]
        while len(pieces) > 2:
            found = [(machine.joined[p], k) for k, p in enumerate(zip(pieces, pieces[1:], strict=False)) if p in machine.joined]
            if not found:
                break
            r, k = min(found)
            pieces[k : k + 2] = [order[r]]
        if len(pieces) == 2 and machine.joined.get(tuple(pieces)) == machine.rank[i]:
            machine.halves[i] = (pieces[0], pieces[1])
            arcs[s] = i
    machine.tree = _tree(arcs)
    return machine


class PieceEncoder:
    """A transducer with a worker's memory of parts."""

    def __init__(self, machine: Transducer) -> None:
        self.machine = machine
        self.known: dict[str, bytes] = {}
        self.parts = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in machine.inner else f"{MARK}*[^{MARK}]+|{MARK}+")

        self.code = "H" if len(machine.text) <= 1 << 16 else "I"

    def _known(self, part: str, text: str) -> bytes:
        """Ids of a part under its key. A sign that no piece joins to the letter before is a part of its own."""
        got = self.known.get(part)
        if got is None:
            if text[-1:] in self.machine.closing and text[-2:-1].isalpha():
                got = self._known(part[:-1], text[:-1]) + self._known("\n" + text[-1], text[-1])
            else:
                got = array(self.code, self.machine.part(text)).tobytes()
            self.known[part] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        kind = "<u2" if len(self.machine.text) <= 1 << 16 else "<u4"
        if not text:
            return np.zeros(0, kind)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        m, known = self.machine, self.known
        whole = m.normal.rewritten(text)
        if not m.cuttable:
            return np.asarray(m.part(m.normal.marked(text)), kind)
        if "  " in whole or whole[:1] == " " or whole[-1:] == " " and m.normal.tidy or MARK in whole or "\n" in m.inner or not m.normal.prefix or not whole:
            got = np.frombuffer(b"".join(self._known("\n" + p, p) for p in self.parts.findall(m.normal.marked(text))), kind)
        else:
            # Words with a mark are kept by the word, those at a line's start (but the first) behind a space.
            words: list[str] = []
            for k, line in enumerate(whole.split("\n")):
                own = line.split(" ")
                if k:
                    words.append("\n\n")
                    own[0] = " " + own[0]
                words += own
            for w in {w for w in words if w not in known}:
                self._known(w, "\n" if w == "\n\n" else w[1:] if w[:1] == " " else MARK + w)
            got = np.frombuffer(b"".join(map(known.__getitem__, words)), kind)
        # Unknown characters side by side are one, across parts too.
        return got if m.byte or len(got) < 2 else got[np.concatenate([[True], (got[1:] != m.unknown) | (got[:-1] != m.unknown)])]


_WORKER: dict[int, PieceEncoder] = {}


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' rows as (id, ids, n_tokens, ids_crc32, decoded, round_trip).

    ``ids`` is what the model's own encoder gives for the whole text, ``decoded`` the text that the
    ids spell, ``round_trip`` whether it is the text (a text that holds the mark itself comes back
    with a space for it). ``ids_crc32`` is the CRC-32 of the ids as little-endian unsigned 32-bit
    integers. A null text gives no ids, a null ``decoded`` and a true ``round_trip``; an empty text
    gives no ids. Repeated rows and null ids give rows of their own; other columns aren't read. An
    empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(compile_model(model))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(sent.value)
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = PieceEncoder(sent.value)
        encoder = _WORKER[key]
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                texts = batch.column(1).to_pylist()
                ids = [encoder.encode(t or "").astype("<i4") for t in texts]
                size = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, "<i4")
                decoded = [None if t is None else encoder.machine.decode(x).decode("utf-8", "replace") for t, x in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(flat)), pa.array(size),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(decoded, pa.string()),
                    pa.array([t == d for t, d in zip(texts, decoded, strict=True)]),
                ], names=["id", "ids", "n_tokens", "ids_crc32", "decoded", "round_trip"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long, ids_crc32 long, decoded string, round_trip boolean")
    return out.withColumnRenamed("id", id_col)
