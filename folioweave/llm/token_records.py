"""Token ids in framed binary records, with an offset index for shuffled reads.

Data file: one frame a document,

    uint64  length of the payload in bytes        (little-endian, as all numbers here)
    uint32  masked CRC-32 of the eight length bytes
    bytes   payload: int64 document id, uint8 1 if that id is null, uint8 bytes a token id, token ids
    uint32  masked CRC-32 of the payload

where masked(c) = rotate right by 15 bits, plus 0xA282EAD8. Index file: for each frame its offset
in the data file and its number of ids, as two uint64. Ids take two bytes each where the
vocabulary allows it. Both files of a part are written by one task in document order under a name
of that attempt only; just the attempts that the job reports are read, so tasks that are lost,
run again or run twice leave no trace in a result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, full_uri, store_of, xor_key

#: Distinct words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_200_000
READ = 1 << 22
MANIFEST = "part int, file string, documents long, ids long"

_WORKER: dict = {}


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


class WordEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct word once.

    The pre-tokenizer of such a vocabulary never joins what stands on both sides of a single space
    or newline between two characters that aren't white space; the space opens the token that
    follows, the newline is a token. So a text is cut there and the ids of its words are joined. New
    words go to the library many at a time, set apart in the same way. Texts with other white space
    and those that hold the string of a special token are encoded in one piece.
    """

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores out
        self.tool = Tokenizer.from_file(path)
        size = self.tool.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.line = self._raw(["\n"])[0]
        # In this vocabulary's alphabet U+0120 stands for the space and U+010A for the newline.
        opens = np.array([(self.tool.id_to_token(i) or "")[:1] == "\u0120" for i in range(size)])
        self.opens, self.breaks = opens, np.arange(size) == self.tool.token_to_id("\u010a")
        self.known: dict[str, bytes] = {}
        self.marks = {c: self._raw([c])[0] for c in ".,"}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.tool.encode_batch(texts, add_special_tokens=False)]

    def _apart(self, words: list[str], gap: str, border: np.ndarray) -> None:
        """Learn words that follow ``gap``; ``border`` tells the ids that such a word begins with."""
        width = self.kind.itemsize
        chunks = [words[k : k + 128] for k in range(0, len(words), 128)]
        tokens = self.tool.encode_batch_fast([gap + gap.join(c) for c in chunks], add_special_tokens=False)
        for chunk, found in zip(chunks, tokens, strict=True):
            ids = np.asarray(found.ids, self.kind)
            at = np.append(np.flatnonzero(border[ids]), len(ids)).tolist()
            skip = int(gap == "\n")
            raw = ids.tobytes()
            key = [" " + w for w in chunk] if skip else chunk
            self.known.update((w, raw[(a + skip) * width : b * width]) for w, a, b in zip(key, at[:-1], at[1:], strict=True))

    def _learn(self, new: set[str]) -> None:
        """Ids of new words; those at a line's start bear a space in front as their mark."""
        base: dict[str, str] = {}
        for w in new:
            # A full stop or comma behind a letter is a token of its own.
            if w[-1:] in self.marks and w[-2:-1].isalpha():
                base[w] = w[:-1]
        need = {base.get(w, w) for w in new}
        need.difference_update(self.known)
        self._apart([w for w in need if w[:1] != " "], " ", self.opens)
        self._apart([w[1:] for w in need if w[:1] == " "], "\n", self.breaks)
        self.known.update({w: self.known[b] + self.marks[w[-1]] for w, b in base.items()})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known["\n\n"] = self.line
        out: list[bytes] = [b""] * len(texts)
        whole, cut, new = [], [], set()
        for i, t in enumerate(texts):
            if not t:
                continue
            # Single spaces and newlines are all the white space there is, and none at the ends.
            bare, gaps = t.split(), t.count(" ") + t.count("\n")
            if len(bare) != gaps + 1 or sum(map(len, bare)) + gaps != len(t) or any(s in t for s in self.special):
                whole.append(i)
                continue
            words: list[str] = []
            for k, line in enumerate(t.split("\n")):
                own = line.split(" ")
                own[0] = " " + own[0]
                if k:
                    words.append("\n\n")
                words += own
            new.update(set(words).difference(self.known))
            cut.append((i, words))
        for i, ids in zip(whole, self._raw([texts[i] for i in whole]), strict=True):
            out[i] = ids
        self._learn(new)
        for i, words in cut:
            out[i] = b"".join(map(self.known.__getitem__, words))
        return out


def _encoder(path: str) -> WordEncoder:
    if path not in _WORKER:
        _WORKER[path] = WordEncoder(path)
    return _WORKER[path]


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to ``out`` in ascending order of id; the manifest, one row a part file.

    Ties of an id are ordered by their text's hash; null ids come first; a null text is empty.
    """
    spark = docs.sparkSession
    out = full_uri(spark, out)
    source, name = store_of(out)
    source.create_dir(name, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = store_of(out)
        file = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        encoder = _encoder(tokenizer)
        tail = b"" if end_id is None else np.asarray([end_id], encoder.kind).tobytes()
        width = encoder.kind.itemsize
        documents = ids = offset = 0
        data = index = None
        for batch in batches:
            if data is None:
                data, index = store.open_output_stream(f"{at}/{file}.rec"), store.open_output_stream(f"{at}/{file}.idx")
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                keys = part.column(0).to_pylist()
                frames, places = [], []
                for key, got in zip(keys, encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    got += tail
                    done = frame(int(key or 0).to_bytes(8, "little", signed=True) + bytes((key is None, width)) + got)
                    frames.append(done)
                    places.append((offset, len(got) // width))
                    offset += len(done)
                    ids += len(got) // width
                documents += len(keys)
                data.write(b"".join(frames))
                index.write(np.asarray(places, "<u8").tobytes())
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "file": file, "documents": documents, "ids": ids}], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), xor_key(F.col(text_col)).alias("tie"))
        .repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    )
    # One row a part file comes to the driver, not one a document.
    done = sorted(ordered.mapInArrow(run, MANIFEST).collect(), key=lambda r: r["part"])
    return spark.createDataFrame(done, MANIFEST)


def _frames(stream: pa.NativeFile) -> Iterator[memoryview]:
    while head := stream.read(12):
        size = int.from_bytes(head[:8], "little")
        body = stream.read(size + 4)
        if masked(head[:8]) != int.from_bytes(head[8:], "little") or len(body) != size + 4 or masked(body[:-4]) != int.from_bytes(body[-4:], "little"):
            raise ValueError("a record is damaged")
        yield memoryview(body)[:-4]


def read_records(spark: SparkSession, out: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32, ids) from the part files that ``manifest`` names.

    ``ids`` is the little-endian unsigned 32-bit form of the token ids as binary, null if they aren't
    asked for. Every frame is
    checked against both of its checksums and against the index.
    """
    out, starts, total = full_uri(spark, out), [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        starts.append((r["file"], total))
        total += r["ids"]
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(out)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, offset = [], 0, 0
                with store.open_input_stream(f"{at}/{file}.rec", buffer_size=READ) as data, store.open_input_stream(f"{at}/{file}.idx", buffer_size=READ) as index:
                    for body in _frames(data):
                        place = np.frombuffer(index.read(16), "<u8")
                        ids = np.frombuffer(body[10:], f"<u{body[9]}").astype("<u4").tobytes()
                        if int(place[0]) != offset or int(place[1]) * 4 != len(ids):
                            raise ValueError("the index doesn't fit the records")
                        key = None if body[8] else int.from_bytes(body[:8], "little", signed=True)
                        rows.append((key, start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                        start += len(ids) // 4
                        offset += len(body) + 16
                        held += len(ids)
                        if held > 4 * READ:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.createDataFrame(starts, "file string, start long").repartition(max(1, len(starts)), "file")
    return files.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long, ids binary")


def shuffled_sample(out: str, file: str, seed: int, n: int) -> list[tuple[int | None, np.ndarray]]:
    """``n`` documents of a part file in random order, each by one seek through the index."""
    store, at = store_of(out)
    with store.open_input_file(f"{at}/{file}.idx") as index:
        places = np.frombuffer(index.read(), "<u8").reshape(-1, 2)
    found = []
    with store.open_input_file(f"{at}/{file}.rec") as data:
        for k in np.random.default_rng(seed).permutation(len(places))[:n]:
            data.seek(int(places[k, 0]))
            body = next(_frames(data))
            found.append((None if body[8] else int.from_bytes(body[:8], "little", signed=True), np.frombuffer(body[10:], f"<u{body[9]}").astype(np.int64)))
    return found


def token_table(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", out: str | None = None, with_ids: bool = True) -> DataFrame:
    """Write ``docs`` as records below the shared folder (or ``out``) and read them back.

    One row (id, start, n_tokens, ids_crc32, ids) for each row of ``docs``: ``start`` counts the
    ids of all documents before it, ``n_tokens`` includes the end id. Ids are integers, or what can be
    cast to long, and come back as longs. A null text is an empty one, null ids come first, repeated
    ids each keep their row. Other columns are not read, whatever they are called. An empty table
    writes no part and gives an empty result. The records stay: they are the operator's product, and
    of a task that ran twice only the files that the manifest names count.
    """
    out = out or fresh_path(docs.sparkSession, "records")
    manifest = write_records(docs, out, tokenizer, end_id, id_col, text_col)
    return read_records(docs.sparkSession, out, manifest, with_ids).withColumnRenamed("id", id_col)
