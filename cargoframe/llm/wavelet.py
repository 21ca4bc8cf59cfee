"""Token ids of documents in wavelet-matrix shards, one compressed file per partition.

A shard holds the ids of consecutive documents (by doc_id) as bit-planes from the highest bit
down. Each plane is packed to bytes with a running count of ones every ``BLOCK`` bits, so that
access, rank and select of any id work on the stored bytes. A file is a compressed Parquet
file whose rows are shards; a shard is closed at the first document end past ``SHARD_TOKENS``.

Null and empty texts are the end id alone; null ids come first; rows with the same id are
kept, ordered by text. An empty table gives files without a shard.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cargoframe.llm.tokens import shared
from cargoframe.sources.scratch import ship

SHARD_TOKENS = 1 << 20
BLOCK = 512
_BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)
SCHEMA = ("part int, shard int, n_tokens long, bits int, doc_ids array<long>, doc_tokens array<long>, "
          "ones array<binary>, planes array<binary>, zeros array<long>")


def _kind(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


class WaveletMatrix:
    """Sequence of ids below 2**bits with access, rank, select and decode."""

    def __init__(self, n: int, bits: int, planes: list[bytes], ones: list[bytes], zeros: list[int]):
        self.n, self.bits, self.zeros = n, bits, list(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ones = [np.frombuffer(o, "<u4") for o in ones]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        kind = _kind(bits)
        planes, ones, zeros, now = [], [], [], ids.astype(kind)
        for level in range(bits - 1, -1, -1):
            bit = (now & kind(1 << level)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
            count = _BYTE_ONES[packed].reshape(-1, BLOCK // 8).sum(1)
            ones.append(np.concatenate([[0], np.cumsum(count)]).astype("<u4").tobytes())
            planes.append(packed.tobytes())
            zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([np.compress(~bit, now), np.compress(bit, now)])
        return cls(len(ids), bits, planes, ones, zeros)

    def _rank1(self, level: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        block, rest = divmod(at, BLOCK)
        count = int(self.ones[level][block])
        if rest:
            base = block * (BLOCK // 8)
            whole, odd = divmod(rest, 8)
            count += int(_BYTE_ONES[self.planes[level][base:base + whole]].sum())
            if odd:
                count += bin(int(self.planes[level][base + whole]) & ((1 << odd) - 1)).count("1")
        return count

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (at & 7) & 1

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._rank1(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for level in range(self.bits):
            a, b = self._rank1(level, low), self._rank1(level, high)
            if symbol >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, symbol: int, end: int) -> int:
        """Occurrences of an id before position ``end``."""
        if symbol >> self.bits:
            return 0
        low, high = self._range(symbol, end)
        return high - low

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        if not 0 <= k < self.rank(symbol, self.n):
            raise IndexError(k)
        at = self._range(symbol, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - level) & 1
            at = self._nth(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th one (or zero) of a plane."""
        counts = self.ones[level].astype(np.int64)
        if not bit:
            counts = np.arange(len(counts)) * BLOCK - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        base = block * (BLOCK // 8)
        inside = np.unpackbits(self.planes[level][base:base + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - int(counts[block])])

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the lowest."""
        kind = _kind(self.bits)
        now = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            before = np.empty(self.n, kind)
            before[np.flatnonzero(~bit)] = now[:self.zeros[level]]
            before[np.flatnonzero(bit)] = now[self.zeros[level]:] | kind(1 << self.bits - 1 - level)
            now = before
        return now.astype(np.uint32)


def _encode(path: str, end_id: int, bits: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encoder, docs, held, size = shared(path), [], [], 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(held), bits)
            row = {"part": part, "shard": shard, "n_tokens": matrix.n, "bits": bits, "doc_ids": docs,
                   "doc_tokens": [len(h) for h in held], "ones": [o.tobytes() for o in matrix.ones],
                   "planes": [p.tobytes() for p in matrix.planes], "zeros": matrix.zeros}
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(ids_of), 500):
                for doc, ids in zip(ids_of[low:low + 500], encoder.batch(texts[low:low + 500])):
                    docs.append(doc)
                    held.append(np.append(ids, np.uint32(end_id)).astype(np.uint32))
                    size += len(held[-1])
                    if size >= shard_tokens:
                        yield close()
                        docs, held, size, shard = [], [], 0, shard + 1
        if held:
            yield close()
    return run


_SHARD = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("bits", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
    ("ones", pa.list_(pa.binary())), ("planes", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64())),
])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, bits: int = 16,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all texts and write the shard files, documents in ascending doc_id order.

    ``bits`` must hold every id. The files are split by ranges of (doc_id, text hash), so no
    id gathers in one task.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                         F.xxhash64("text").alias("tie"))
    files = max(source.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (source.repartitionByRange(files, F.asc_nulls_first("doc_id"), "tie")
               .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie"))
    (ordered.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id, bits, shard_tokens), SCHEMA)
     .write.option("compression", "zstd").parquet(path))


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["bits"], row["planes"], row["ones"], row["zeros"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def read_documents(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Documents decoded from the files: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32, token_ids (little-endian unsigned 32-bit; null unless ``keep_ids``)."""
    ship(spark)
    shards = spark.read.schema(SCHEMA).parquet(path)

    def decode(batches):
        for row in _rows(batches):
            ids, start, out = _matrix(row).decode().astype("<u4"), 0, []
            for doc, n in zip(row["doc_ids"], row["doc_tokens"]):
                raw = ids[start:start + n].tobytes()
                out.append((row["part"], row["shard"], doc, start, n, zlib.crc32(raw), raw if keep_ids else None))
                start += n
            names = ["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32", "token_ids"]
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    found = shards.mapInArrow(decode, "part int, shard int, doc_id long, start long, n_tokens long, "
                                      "ids_crc32 long, token_ids binary")
    # one row per file, then one row per shard of a file: neither holds documents
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("file_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begin = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("shard_start"))
    begin = begin.join(files, "part").select(
        "part", "shard", (F.col("file_start") + F.col("shard_start")).alias("base"))
    return found.join(begin, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "token_ids")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """One row: occurrences of an id in all files, by rank."""
    ship(spark)

    def count(batches):
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_matrix(row).rank(token, row["n_tokens"])], pa.int64())], ["n"])

    return (spark.read.schema(SCHEMA).parquet(path).mapInArrow(count, "n long")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every occurrence of an id by select: doc_id and position within the document."""
    ship(spark)

    def find(batches):
        for row in _rows(batches):
            matrix, begin = _matrix(row), np.cumsum([0, *row["doc_tokens"]])
            at = np.array([matrix.select(token, k) for k in range(matrix.rank(token, matrix.n))], np.int64)
            doc = np.searchsorted(begin, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["doc_ids"][d] for d in doc], pa.int64()), pa.array(at - begin[doc])],
                ["doc_id", "position"])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(find, "doc_id long, position long")
