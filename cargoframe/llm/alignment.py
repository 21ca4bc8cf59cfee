"""Alignment of two tokenizers' ids over the same bytes, with corpus-wide counts of id pairs.

Every text, with a blank before it, is encoded by a byte-level BPE (A) and a piece model (B). Byte
offsets where tokens of both end cut the ids into groups, and the two tokens that end there are
linked. The work has these steps:

1. One pass encodes, writes the ids as 16- or 32-bit binaries and the distinct pairs of each task.
2. The distinct pairs, dealt into shards by hash, get a minimal perfect hash: buckets of about four
   keys, each with a pilot that sends its keys to free slots. The key of every slot is kept and
   compared at each lookup.
3. A second pass over the ids aligns again and adds into one dense vector per task, indexed by the
   hash. The vectors are cut into blocks and summed as a tree of fan-in ``FAN``.
4. A last pass aligns each document and looks its pairs up.

Linked tokens end at the same byte, so the bytes of one are a suffix of the other's: the number of
pairs is bounded by the two vocabularies (``pair_bound``), whatever the corpus holds. Hash, keys
and counts are broadcast behind a check of that bound.

Null, empty and unfaithful texts (joined token bytes of A or B differ from blank + text) have no
tokens: zeros, empty ids and an empty ``groups``. Null or repeated ids and repeated rows are rows
like any other and count each time. Columns other than doc_id and text are not read, whatever
their names. An empty table gives no row and no pair.
"""

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from cargoframe.llm import tokens as token_ids
from cargoframe.llm.words import buffers, mix
from cargoframe.sources.scratch import settle, ship

#: Shards of the hash, keys to a bucket, pilots tried at once, slots to a block, vectors summed by one group.
SHARDS, BUCKET, TRIES, BLOCK, FAN = 64, 4, 64, 1 << 14, 16
#: Bytes encoded together; chunks, and units of A, that a Python worker remembers.
SLICE, REMEMBERED, UNITS = 1_000_000, 100_000, 300_000
#: Pairs that may be broadcast; vocabularies that allow more are refused.
MOST_PAIRS = 4_000_000

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s")


def _byte_alphabet() -> dict[str, int]:
    """Characters by which a byte-level vocabulary writes the 256 bytes: printable ones stand for
    themselves, the others take the code points from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers and the bytes of every id. ``kind`` is the dtype of stored ids."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = token_ids.shared(a_path, plain=True).tokenizer
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        self.a_bytes = [bytes(alphabet[c] for c in self.a.id_to_token(i) or "" if c in alphabet)
                        for i in range(self.a.get_vocab_size())]
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else
            self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.kind = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")

    def pair_bound(self) -> int:
        """Number of id pairs of which one's bytes are a suffix of the other's."""
        def of(longer: list[bytes], shorter: list[bytes], least: int) -> int:
            number: dict[bytes, int] = {}
            for x in shorter:
                number[x] = number.get(x, 0) + 1
            return sum(number.get(x[i:], 0) for x in longer for i in range(least, len(x)))
        return of(self.a_bytes, self.b_bytes, 0) + of(self.b_bytes, self.a_bytes, 1)

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key of every link, position of its A token, of its B token) over ids of the same bytes."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        last = int(a_end[-1]) if len(a_end) else 0
        mark = np.zeros(last + 1, bool)
        mark[a_end] = True
        b_at = np.flatnonzero(mark[b_end])
        mark[a_end] = False
        mark[b_end] = True
        a_at = np.flatnonzero(mark[a_end])
        return a[a_at].astype(np.int64) * len(self.b_bytes) + b[b_at], a_at, b_at


class _Bytes:
    """The bytes of all ids in one array."""

    def __init__(self, tokens: list[bytes], size: np.ndarray):
        self.data, self.size = np.frombuffer(b"".join(tokens), np.uint8), size
        self.starts = np.cumsum(size) - size

    def spell(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which of the texts ``data[offsets]`` are the joined bytes of their ids."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        made = self.data[np.repeat(self.starts[ids] - ends[:-1], size) + np.arange(ends[-1])]
        length, want = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]), np.diff(offsets)
        good = length == want
        row = np.repeat(np.flatnonzero(good), want[good])
        good[row[made[np.repeat(good, length)] != data[np.repeat(good, want)]]] = False
        return good


class _Flat:
    """Ids of all remembered chunks in one array that doubles when full."""

    def __init__(self, kind: np.dtype):
        self.data, self.end = np.zeros(1 << 16, kind), 0
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.n = 0

    def extend(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.end + len(ids) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.n + len(counts) > len(self.counts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.data[self.end:self.end + len(ids)] = ids
        at = slice(self.n, self.n + len(counts))
        self.counts[at], self.starts[at] = counts, self.end + np.cumsum(counts) - counts
        self.end, self.n = self.end + len(ids), self.n + len(counts)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[which]
        shift = np.repeat(self.starts[which] - (np.cumsum(counts) - counts), counts)
        return self.data[shift + np.arange(len(shift))], counts


def _edges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class Encoder:
    """Ids and groups of whole texts from chunks between single blanks, each encoded once.

    A blank between two non-blanks starts a token in A (its pre-tokens are cut there) and in B (no
    piece holds a blank after another character), so a group never crosses such a place. New chunks
    are checked and grouped as arrays; A's ids come from units that are remembered in their turn, so
    a word met before with other punctuation is not encoded again.
    """

    def __init__(self, a_path: str, b_path: str):
        self.words = Vocabularies(a_path, b_path)
        if any(b" " in x.lstrip(b" ") for x in self.words.b_bytes):
            raise ValueError("a piece holds a blank behind another character; chunks would not be independent")
        self.units = token_ids.shared(a_path, plain=True)
        self.units.most = UNITS
        self.a_bytes = _Bytes(self.words.a_bytes, self.words.a_size)
        self.b_bytes = _Bytes(self.words.b_bytes, self.words.b_size)
        # every id in decimal digits, with room for a sign behind them
        names = [str(i) for i in range(max(len(self.words.a_bytes), len(self.words.b_bytes)))]
        self.digits = np.array([len(x) for x in names], np.int64)
        self.decimals = np.array(names, f"S{len(names[-1]) + 1}").view(np.uint8).reshape(len(names), -1)
        self._forget()

    def _forget(self) -> None:
        # the number of groups is -1 for a chunk that is not faithful
        self.number: dict[str, int] = {}
        self.a, self.b = _Flat(self.words.kind), _Flat(self.words.kind)
        self.groups: list[bytes] = []
        self.n_groups = np.zeros(0, np.int32)

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks (without the blank before them) that are not known yet."""
        new = list(set(chunks).difference(self.number))
        if not new:
            return
        v = self.words
        column = pa.array([" " + c for c in new], pa.large_string())
        data, offsets = buffers(column)
        a, b = self.units.batch(column), v.b.encode(new, num_threads=1)
        a_counts, b_counts = (np.fromiter(map(len, x), np.int64, len(new)) for x in (a, b))
        a = np.concatenate(a).astype(v.kind)
        b = np.fromiter(chain.from_iterable(b), v.kind, int(b_counts.sum()))
        good = self.a_bytes.spell(a, a_counts, data, offsets) & self.b_bytes.spell(b, b_counts, data, offsets)
        texts, n = self._group(a[np.repeat(good, a_counts)], b[np.repeat(good, b_counts)],
                               np.where(good, a_counts, 0), np.where(good, b_counts, 0))
        self.number.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        self.groups += texts
        self.n_groups = np.concatenate([self.n_groups, np.where(good, n, -1).astype(np.int32)])
        self.a.extend(a, a_counts)
        self.b.extend(b, b_counts)

    def _group(self, a: np.ndarray, b: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The groups of every chunk in the digest's notation, and their number, from the ids of all."""
        _, a_last, b_last = self.words.links(a, b)
        a_ends, b_ends = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_ends[a_last] = b_ends[b_last] = 1
        # B's tokens of the earlier groups stand before a token of A, A's of its own group too before one of B
        a_at = np.arange(len(a)) + np.append(0, b_last + 1)[np.cumsum(a_ends) - a_ends]
        b_at = np.arange(len(b)) + np.append(a_last + 1, 0)[np.cumsum(b_ends) - b_ends]
        ids, signs = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[a_at], ids[b_at] = a, b
        signs[a_at], signs[b_at] = np.where(a_ends, ord("|"), ord(",")), np.where(b_ends, ord(";"), ord(","))
        size, rows = self.digits[ids], self.decimals[ids]
        rows[np.arange(len(ids)), size] = signs
        text = rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes()
        at = _edges(size + 1)[_edges(a_counts + b_counts)].tolist()
        n = np.diff(_edges(a_ends)[_edges(a_counts)])
        return [text[low:high - 1] if high > low else b"" for low, high in zip(at, at[1:])], n

    def batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, int]]:
        """A's ids, B's ids, the groups and their number, per text."""
        if len(self.number) > REMEMBERED:
            self._forget()
        parts = []
        for text in texts:
            if not text:
                parts.append([])
                continue
            plain = not (_DOUBLE.search(text) or text[0].isspace() or text[-1].isspace())
            parts.append(text.split(" ") if plain else _BETWEEN.split(text))
        chunks, counts = list(chain.from_iterable(parts)), np.fromiter(map(len, parts), np.int64, len(parts))
        self._learn(chunks)
        which = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        # a text with an unfaithful chunk has no tokens
        row = np.repeat(np.arange(len(parts)), counts)
        whole = np.ones(len(parts), bool)
        whole[row[self.n_groups[which] < 0]] = False
        which, first = which[whole[row]], _edges(np.where(whole, counts, 0))
        (a, a_counts), (b, b_counts) = self.a.take(which), self.b.take(which)
        a_at, b_at = _edges(a_counts)[first].tolist(), _edges(b_counts)[first].tolist()
        n = np.diff(_edges(self.n_groups[which])[first]).tolist()
        groups, first = [self.groups[i] for i in which.tolist()], first.tolist()
        for i in range(len(parts)):
            yield (a[a_at[i]:a_at[i + 1]], b[b_at[i]:b_at[i + 1]], b";".join(groups[first[i]:first[i + 1]]), n[i])


#: One encoder per Python worker and pair of paths; a worker serves many tasks.
_ENCODERS: dict[tuple[str, str], Encoder] = {}
_VOCABULARIES: dict[tuple[str, str], Vocabularies] = {}


def _encoder(a_path: str, b_path: str) -> Encoder:
    key = (a_path, b_path)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(a_path, b_path)
        _VOCABULARIES[key] = _ENCODERS[key].words
    return _ENCODERS[key]


def _vocabularies(a_path: str, b_path: str) -> Vocabularies:
    key = (a_path, b_path)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabularies(a_path, b_path)
    return _VOCABULARIES[key]


_TOKENS = ("doc_id long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, "
           "a_ids binary, b_ids binary, pairs binary")
_TOKENS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("groups", pa.string()), ("groups_sha256", pa.string()), ("a_ids", pa.binary()), ("b_ids", pa.binary()),
    ("pairs", pa.binary())])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most about SLICE bytes."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64) + 1
    run = np.cumsum(sizes) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    return zip(edges[:-1], edges[1:])


def _encode(a_path: str, b_path: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        encoder = _encoder(a_path, b_path)
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for low, high in _slices(batch.column(1)):
                rows, a_all, b_all = [], [], []
                docs, texts = (batch.column(i).slice(low, high - low).to_pylist() for i in (0, 1))
                for doc, (a, b, groups, n) in zip(docs, encoder.batch(texts)):
                    digest = hashlib.sha256(groups).hexdigest() if len(a) else ""
                    rows.append((doc, len(a), len(b), n, groups.decode() if keep_groups else None, digest,
                                 a.tobytes(), b.tobytes(), None))
                    a_all.append(a)
                    b_all.append(b)
                keys = encoder.words.links(np.concatenate(a_all), np.concatenate(b_all))[0]
                seen = np.union1d(seen, keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _TOKENS_ARROW)], schema=_TOKENS_ARROW)
        # the distinct pairs of the task, at most pair_bound, in one more row
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(1, f.type) for f in _TOKENS_ARROW][:-1], pa.array([seen.astype("<i8").tobytes()], pa.binary())],
            schema=_TOKENS_ARROW)
    return run


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            keys = np.frombuffer(raw, "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array((mix(keys.view(np.uint64)) & np.uint64(SHARDS - 1)).astype(np.int32))],
                ["key", "shard"])


def build_shard(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilot of every bucket, key of every slot): a minimal perfect hash of distinct keys."""
    n = len(keys)
    h = mix(keys.view(np.uint64))
    buckets = max(1, -(-n // BUCKET))
    bucket = (h >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket.astype(np.int64), minlength=buckets)
    first = np.cumsum(sizes) - sizes
    free, slots, pilots = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(buckets, np.uint32)
    for at in np.argsort(-sizes, kind="stable"):
        size = sizes[at]
        if not size:
            break
        members = order[first[at]:first[at] + size]
        low = 0
        while True:
            tries = np.arange(low, low + TRIES, dtype=np.uint64)
            place = (mix(h[members][None, :] ^ mix(tries + np.uint64(1))[:, None]) % np.uint64(n)).astype(np.int64)
            fits = free[place].all(axis=1)
            if size > 1:
                ranked = np.sort(place, axis=1)
                fits &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            found = np.flatnonzero(fits)
            if len(found):
                pilots[at] = low + found[0]
                free[place[found[0]]] = False
                slots[place[found[0]]] = keys[members]
                break
            low += TRIES
    return pilots, slots


class PairHash:
    """Slots of pair keys: the shards of ``build_shard`` side by side."""

    def __init__(self, shards: dict[int, tuple[np.ndarray, np.ndarray]]):
        none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = [shards.get(s, none) for s in range(SHARDS)]
        self.buckets = np.array([len(p) for p, _ in parts], np.uint64)
        self.sizes = np.array([len(k) for _, k in parts], np.uint64)
        self.pilot_at = (np.cumsum(self.buckets) - self.buckets).astype(np.int64)
        self.slot_at = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)
        self.pilots = np.concatenate([p for p, _ in parts]).astype(np.uint64)
        self.keys = np.concatenate([k for _, k in parts])

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; a key that was never built in gets -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        h = mix(keys.view(np.uint64))
        shard = (h & np.uint64(SHARDS - 1)).astype(np.int64)
        buckets, sizes = np.maximum(self.buckets[shard], 1), np.maximum(self.sizes[shard], 1)
        at = self.pilot_at[shard] + ((h >> np.uint64(32)) % buckets).astype(np.int64)
        pilot = self.pilots[np.minimum(at, len(self.pilots) - 1)]
        slot = self.slot_at[shard] + (mix(h ^ mix(pilot + np.uint64(1))) % sizes).astype(np.int64)
        slot = np.minimum(slot, len(self.keys) - 1)
        return np.where(self.keys[slot] == keys, slot, -1)


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    keys = np.sort(table.column("key").to_numpy())
    pilots, slots = build_shard(keys)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()),
                     "pilots": pa.array([pilots.astype("<u4").tobytes()], pa.binary()),
                     "keys": pa.array([slots.astype("<i8").tobytes()], pa.binary())})


def _documents(batch: pa.RecordBatch, kind: np.dtype, step: int = 2000) -> Iterator[tuple[int, list, list]]:
    """(first row, A's ids, B's ids) of runs of rows of a batch with columns a_ids and b_ids."""
    for low in range(0, len(batch), step):
        part = batch.slice(low, step)
        yield low, *([np.frombuffer(x, kind) for x in part.column(c).to_pylist()] for c in ("a_ids", "b_ids"))


_VECTOR = "near long, block long, counts binary"


def _vector_rows(near: int, vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    for block in range(0, len(vector), BLOCK):
        yield pa.RecordBatch.from_arrays(
            [pa.array([near]), pa.array([block // BLOCK]),
             pa.array([vector[block:block + BLOCK].astype("<i8").tobytes()], pa.binary())], ["near", "block", "counts"])


def _count(a_path: str, b_path: str, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, hashed = _vocabularies(a_path, b_path), table.value
        vector = np.zeros(len(hashed), np.int64)
        for batch in batches:
            for _, a, b in _documents(batch, words.kind):
                keys, times = np.unique(words.links(np.concatenate(a), np.concatenate(b))[0], return_counts=True)
                slots = hashed.slots(keys)
                if (slots < 0).any():
                    raise RuntimeError("a pair of the second pass was not seen in the first")
                vector[slots] += times
        yield from _vector_rows(TaskContext.get().partitionId(), vector)
    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of equal (near, block); rows come sorted by them."""
    current, total = None, None
    for batch in batches:
        for near, block, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if (near, block) != current:
                if current is not None:
                    yield _block_row(current, total)
                current, total = (near, block), np.zeros(len(raw) // 8, np.int64)
            total += np.frombuffer(raw, "<i8")
    if current is not None:
        yield _block_row(current, total)


def _block_row(at: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([at[0]]), pa.array([at[1]]), pa.array([total.astype("<i8").tobytes()], pa.binary())],
        ["near", "block", "counts"])


def tree_sum(vectors: DataFrame, tasks: int) -> DataFrame:
    """One row per block with the sum over ``tasks`` vectors; a group adds at most FAN of them."""
    while tasks > 1:
        vectors = vectors.withColumn("near", F.floor(F.col("near") / FAN).cast("long")).repartition(
            "near", "block").sortWithinPartitions("near", "block").mapInArrow(_sum_blocks, _VECTOR)
        tasks = -(-tasks // FAN)
    return vectors


def _look_up(a_path: str, b_path: str, table, counted, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hashed, counts = _vocabularies(a_path, b_path), table.value, counted.value
        pieces = len(words.b_bytes)
        top = np.zeros(pieces, np.int64)
        np.maximum.at(top, hashed.keys % pieces, counts)
        best = counts == top[hashed.keys % pieces]
        for batch in batches:
            found = np.zeros((3, len(batch)), np.int64)
            for low, a, b in _documents(batch, words.kind):
                keys, _, b_at = words.links(np.concatenate(a), np.concatenate(b))
                row = low + np.repeat(np.arange(len(b)), [len(x) for x in b])[b_at]
                slots = hashed.slots(keys)
                found[0] += np.bincount(row, minlength=len(batch))
                found[1] += np.bincount(row[best[slots]], minlength=len(batch))
                np.add.at(found[2], row, counts[slots])
            kept = [c for c in batch.schema.names if keep_ids or c not in ("a_ids", "b_ids")]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), *map(pa.array, found)], [*kept, "n_links", "n_best", "count_sum"])
    return run


class Alignment(NamedTuple):
    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True, keep_ids: bool = True) -> Alignment:
    """``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest
    of their B id, ties included), count_sum, groups (null unless ``keep_groups``), groups_sha256,
    and with ``keep_ids`` a_ids and b_ids (little-endian). ``pairs``: a_id, b_id, count over the corpus.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    words = _vocabularies(a_path, b_path)
    bound = words.pair_bound()
    if bound > MOST_PAIRS:
        raise ValueError(f"the vocabularies allow {bound} pairs; at most {MOST_PAIRS} may be broadcast")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tokens = settle(source.mapInArrow(_encode(a_path, b_path, keep_groups), _TOKENS), "alignment")
    rows = tokens.filter("pairs IS NULL").drop("pairs")
    keys = tokens.filter("pairs IS NOT NULL").select("pairs").mapInArrow(_pairs_of, "key long, shard int").distinct()
    built = keys.groupBy("shard").applyInArrow(_build, "shard int, pilots binary, keys binary").collect()  # <= SHARDS rows
    hashed = PairHash({r.shard: (np.frombuffer(r.pilots, "<u4"), np.frombuffer(r["keys"], "<i8")) for r in built})
    table = spark.sparkContext.broadcast(hashed)

    vectors = settle(rows.select("a_ids", "b_ids").mapInArrow(_count(a_path, b_path, table), _VECTOR), "vectors")
    tasks = (vectors.agg(F.max("near")).first()[0] or 0) + 1
    counts = np.zeros(len(hashed), np.int64)
    for r in tree_sum(vectors, tasks).collect():  # one vector of at most pair_bound counts
        part = np.frombuffer(r.counts, "<i8")
        counts[r.block * BLOCK:r.block * BLOCK + len(part)] = part
    counted = spark.sparkContext.broadcast(counts)

    schema = ("doc_id long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, "
              f"{'a_ids binary, b_ids binary, ' if keep_ids else ''}n_links long, n_best long, count_sum long")
    documents = rows.mapInArrow(_look_up(a_path, b_path, table, counted, keep_ids), schema)
    pieces = len(words.b_bytes)
    pairs = spark.createDataFrame(
        pa.table({"a_id": hashed.keys // pieces, "b_id": hashed.keys % pieces, "count": counts}))
    return Alignment(documents, pairs)
