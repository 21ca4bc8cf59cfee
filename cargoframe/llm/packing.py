"""Bounded-space online packing of documents into fixed-length token sequences.

Every partition keeps a fixed number of open windows. A piece goes to the fullest window it
fits in (best fit); when it fits in none, the fullest window is emitted. What is still open
at the end of a partition is merged in rounds, each task taking the open windows of
``GATHER`` partitions, until one set of open windows is left.

Null and empty texts are documents that consist of the end id alone. Repeated rows and
repeated ids are packed like any other row. An empty table gives no piece.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cargoframe.llm.tokens import shared
from cargoframe.sources.scratch import settle, ship

#: Open windows of a partition, and partitions whose open windows meet in one task of a merge.
OPEN, GATHER = 64, 32
#: An emitted window with a larger gap is filled up with the head of the next piece.
GAP = 16
#: A sequence id is round * PER_TURN + task (or group of a merge) * PER_TASK + number there.
PER_TASK, PER_TURN = 1 << 30, 1 << 56

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("is_open", T.BooleanType()),
    T.StructField("token_ids", T.BinaryType()),
])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("is_open", pa.bool_()), ("token_ids", pa.binary()),
])


class Windows:
    """Open windows of one task. ``free[i]`` is the room left in window i, -1 if unused."""

    def __init__(self, width: int, first_id: int, keep_ids: bool):
        self.width, self.next_id, self.keep_ids = width, first_id, keep_ids
        self.free = np.full(OPEN, -1, np.int64)
        self.held: list[list] = [[] for _ in range(OPEN)]
        self.rows: list[tuple] = []

    def place(self, pieces: list[tuple]) -> None:
        """Put pieces (doc_id, start, doc_tokens, ids), together at most a window, side by side."""
        size = sum(len(p[3]) for p in pieces)
        fits = np.flatnonzero(self.free >= size)
        if len(fits):
            at = fits[np.argmin(self.free[fits])]
        elif (self.free < 0).any():
            at = int(np.argmax(self.free < 0))
            self.free[at] = self.width
        else:
            at = int(np.argmin(self.free))
            room = int(self.free[at])
            if room > GAP:
                head, pieces = _cut(pieces, room)
                self.held[at] += head
            self.emit(at, False)
            self.free[at] = self.width
            size = sum(len(p[3]) for p in pieces)
        self.held[at] += pieces
        self.free[at] -= size
        if self.free[at] == 0:
            self.emit(at, False)

    def emit(self, at: int, is_open: bool) -> None:
        offset = 0
        for doc, start, total, ids in self.held[at]:
            raw = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.next_id, offset,
                              is_open, raw if is_open or self.keep_ids else None))
            offset += len(ids)
        self.next_id += 1
        self.held[at], self.free[at] = [], -1

    def close(self) -> None:
        for at in np.flatnonzero(self.free >= 0):
            self.emit(at, True)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _cut(pieces: list[tuple], room: int) -> tuple[list, list]:
    """The first ``room`` ids of the pieces, and the rest."""
    head, tail = [], []
    for doc, start, total, ids in pieces:
        if room:
            head.append((doc, start, total, ids[:room]))
        if len(ids) > room:
            tail.append((doc, start + min(room, len(ids)), total, ids[room:]))
        room = max(0, room - len(ids))
    return head, tail


def _first(path: str, width: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = shared(path)
        windows = Windows(width, TaskContext.get().partitionId() * PER_TASK, keep_ids)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(docs), 1000):
                found = encoder.batch(texts[low:low + 1000])
                for doc, ids in zip(docs[low:low + 1000], found):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), width):
                        windows.place([(doc, start, len(ids), ids[start:start + width])])
                yield windows.batch()
        windows.close()
        yield windows.batch()
    return run


def _merge(width: int, turn: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, near, current, held = None, None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["sequence_id"] != current and held:
                    windows.place(held)
                    held = []
                if row["near"] != near:
                    if windows:
                        windows.close()
                        yield windows.batch()
                    near = row["near"]
                    windows = Windows(width, turn * PER_TURN + near * PER_TASK, keep_ids)
                current = row["sequence_id"]
                held.append((row["doc_id"], row["start"], row["doc_tokens"],
                             np.frombuffer(row["token_ids"], "<u4")))
            yield windows.batch()
        if windows:
            windows.place(held)
            windows.close()
            yield windows.batch()
    return run


def pack(docs: DataFrame, tokenizer: str, width: int = 1024, end_id: int = 0,
         keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and token_ids (little-endian unsigned 32-bit; null unless ``keep_ids``).

    A document's ids are those of its text and ``end_id``; blocks of ``width`` ids fill a
    sequence of their own, the rest is placed by best fit.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    done = settle(source.mapInArrow(_first(tokenizer, width, end_id, keep_ids), PIECES), "packed")
    parts, turn = [], 0
    while True:
        parts.append(done.filter("NOT is_open"))
        left = done.filter("is_open").withColumn(
            "near", F.floor(F.col("sequence_id") % F.lit(PER_TURN) / F.lit(PER_TASK * GATHER)))
        top = done.filter("is_open").agg(F.max(F.floor(F.col("sequence_id") % F.lit(PER_TURN) / F.lit(PER_TASK)))).first()[0]
        if not top:  # one task or none is left: its open windows are the last sequences
            parts.append(done.filter("is_open"))
            break
        turn += 1
        merged = (left.repartition("near").sortWithinPartitions("near", "sequence_id", "offset")
                  .mapInArrow(_merge(width, turn, keep_ids), PIECES))
        done = settle(merged, "packed")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(*PIECES.fieldNames()).drop("is_open")
