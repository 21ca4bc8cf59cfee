"""Word positions and hashes of whole Arrow batches with numpy, for use inside Spark tasks."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; wraps around."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: byte ``starts`` and ``ends``, and ``first[i]:first[i + 1]`` per row."""

    def __init__(self, column: pa.Array, lower: bool = False, separators: np.ndarray = SPACES):
        self.data, self.offsets = buffers(column)
        if lower:
            self.data = LOWER[self.data]
        gap = separators[self.data]
        before = np.ones(len(gap) + 1, dtype=bool)
        before[1:] = gap
        edge = self.offsets[self.offsets < len(gap)]
        opening = before[:-1].copy()
        opening[edge] = True
        closing = np.ones(len(gap) + 1, dtype=bool)
        closing[:-1] = gap
        closing[edge] = True
        self.starts = np.flatnonzero(opening & ~gap)
        self.ends = np.flatnonzero(closing[1:] & ~gap) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of every word."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        size = self.ends - self.starts
        out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + 2 * seed & (1 << 64) - 1))
        at = np.flatnonzero(size <= LONG_WORD)
        for k in range(0, LONG_WORD, 8):
            at = at[size[at] > k]
            if not len(at):
                break
            chunk = np.ascontiguousarray(eight[self.starts[at] + k]).view(np.uint64).ravel()
            chunk = chunk & _MASK[np.minimum(size[at] - k, 8)]
            out[at] = mix((out[at] ^ chunk) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k + 1))
        for i in np.flatnonzero(size > LONG_WORD):
            word = self.data[self.starts[i]:self.ends[i]].tobytes()
            digest = hashlib.blake2b(word, digest_size=8, key=str(seed).encode()).digest()
            out[i] = np.frombuffer(digest, np.uint64)[0]
        return out

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start index and hash of every k consecutive words of one row."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[j:n + j]
        whole = np.flatnonzero(self.row[:n] == self.row[k - 1:])
        return whole, mix(total[whole] + np.uint64(k))


def free_names(docs, *wanted: str) -> list[str]:
    """Helper names that no column of ``docs`` has, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as the bigint of the same bits."""
    return pa.array(x.view(np.int64))


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the number of values per row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns, then ``text`` compressed for a shuffle: packed and size; null stays null."""
    codec = pa.Codec("zstd")
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        null, sizes = batch.column("text").is_null().to_pylist(), np.diff(offsets)
        packed = [None if gone else codec.compress(data[low:low + n].tobytes(), asbytes=True)
                  for gone, low, n in zip(null, offsets, sizes)]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(packed, pa.binary()), pa.array(sizes)], [*kept, "packed", "size"])


def unpacked(batch: pa.RecordBatch) -> pa.Array:
    """The texts of ``packed_texts``, as bytes."""
    codec = pa.Codec("zstd")
    return pa.array([None if p is None else codec.decompress(p, n, asbytes=True) for p, n in zip(
        batch.column("packed").to_pylist(), batch.column("size").to_pylist())], pa.large_binary())
