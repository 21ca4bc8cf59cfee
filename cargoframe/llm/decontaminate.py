"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK random walk reads a sequence of words, puts out the current one at every step and moves
on by a random bit of (step, word); sequences at small edit distance agree at many steps. A key
is the hash of the outputs at a few sampled steps. Items and documents are embedded from every
word on, each repetition with bits and samples of its own. Equal
keys propose (document, item, diagonal), which the exact edit distance over words decides: an
item is found where some part of the document is within ``1 - similarity`` of its words.

Steps and repetitions follow from an item's length and ``TARGET``, the least recall of an item with
as many edits as ``similarity`` allows, at the worst places. ``d`` edits leave the other words in
``d + 1`` runs, so that ``n - d - (d + 1) * (w - 1)`` windows of ``w`` words or more are untouched.
A walk that reads all words of a window and no other, agrees there for certain; items keep
just these walks. A length takes the widest windows that reach the target within ``MAX_REPEATS``.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, compared in
ASCII lower case. Executors drop early what cannot
match by two bitmaps of fixed size over the item words and the keys as far as they are read;
larger benchmarks only fill
them up. Null or empty texts and items match nothing. Repeated rows give one result row per
(doc_id, item_id). Null ids are kept as null. Empty tables give no row.
"""

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cargoframe.llm.words import SPACES, Words, mix
from cargoframe.sources.scratch import settle, ship

#: Least recall at ``similarity``, sampled steps of a key, most words of a window, most repetitions.
TARGET, SAMPLES, WIDEST, MAX_REPEATS = 0.999, 6, 8, 10
BITMAP = 22
SIMILARITY = 0.8
ROWS = 2000

_SEPARATORS = SPACES.copy()
_SEPARATORS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _last(width: int) -> int:
    """The step at which a walk stands most often on the last word of a window."""
    return max(0, 2 * width - 3)


@cache
def _plan(words: int, similarity: float) -> tuple[int, int]:
    """(words of a window, repetitions) for an item of so many words."""
    edits = int((1 - similarity) * words + 1e-9)
    for width in range(min(WIDEST, words), 1, -1):
        clean = words - edits - (edits + 1) * (width - 1)
        if clean > 0:
            miss = 1 - math.comb(_last(width), width - 1) / 2 ** _last(width)
            repeats = math.ceil(math.log(1 - TARGET) / (clean * math.log(miss)))
            if repeats <= MAX_REPEATS:
                return width, repeats
    return 1, 1  # an untouched word is read for certain


def _steps(width: int, repeat: int) -> np.ndarray:
    """Sampled steps of a repetition; the first, the start word, and the last are among them."""
    last = _last(width)
    later = np.random.default_rng([11, width, repeat]).permutation(np.arange(1, max(1, last)))[:SAMPLES - 2]
    return np.unique(np.concatenate([[0], later, [last]]))


def _walk(hashes: np.ndarray, at: np.ndarray, ends: np.ndarray, width: int, repeat: int, alive=None):
    """Starts that survive, where they end, and (starts, keys) after every sample. ``alive(keys)`` marks
    keys worth going on with; a walk past the end of its row (``ends`` by word) is dropped."""
    bits = mix(hashes ^ np.uint64(0x51ED27 + 7919 * repeat))
    key = np.full(len(at), np.uint64(width * 64 + repeat))
    here, begin, wanted, trail = at.copy(), at, set(_steps(width, repeat).tolist()), []
    for step in range(_last(width) + 1):
        if step:
            inside = np.minimum(here, len(hashes) - 1)
            here = here + ((bits[inside] >> np.uint64(step)) & np.uint64(1)).astype(here.dtype)
        if step in wanted:
            go = here < ends[begin]
            begin, here, key = begin[go], here[go], key[go]
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[here])
            if alive is not None:
                go = alive(key)
                begin, here, key = begin[go], here[go], key[go]
            trail.append((begin, key))
    return begin, here, trail


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP)).astype(np.int64)


def _item_walks(batch: pa.RecordBatch, similarity: float):
    """(row, words of a window, repetition, starts, keys after every sample) of the walks that items keep."""
    words = Words(batch.column("text"), lower=True, separators=_SEPARATORS)
    hashes = words.hashes()
    for i in range(batch.num_rows):
        own = hashes[words.first[i]:words.first[i + 1]]
        if not len(own):
            continue
        width, repeats = _plan(len(own), similarity)
        for repeat in range(repeats):
            begin, here, trail = _walk(own, np.arange(len(own)), np.full(len(own), len(own)), width, repeat)
            whole = begin[here - begin == width - 1]
            yield i, width, repeat, whole, [key[np.isin(at, whole)] for at, key in trail]


def _item_keys(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(batch.column("item")[i].as_py(), width, repeat, int(k), int(a))
                    for i, width, repeat, whole, keys in _item_walks(batch, similarity)
                    for a, k in zip(whole, keys[-1].view(np.int64))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()])],
                ["item", "width", "repeat", "key", "item_at"])
    return run


def _item_bits(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for *_, trail in _item_walks(batch, similarity) for k in trail]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.unique(_bit(np.concatenate(keys or [np.zeros(0, np.uint64)]))))], ["bit"])
    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(batch.column("text"), lower=True, separators=_SEPARATORS)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit(words.hashes())))], ["bit"])


def _bitmap(bits: DataFrame) -> np.ndarray:
    marks = np.zeros(1 << BITMAP, bool)
    marks[bits.distinct().toArrow().column("bit").to_numpy()] = True
    return np.packbits(marks)


def _doc_keys(plans: list[tuple[int, int]], word_bits: np.ndarray, key_bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(word_bits).astype(bool)
        used = np.unpackbits(key_bits).astype(bool)
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                words = Words(batch.column("text"), lower=True, separators=_SEPARATORS)
                hashes = words.hashes()
                in_item = np.flatnonzero(known[_bit(hashes)])
                ends = words.first[1:][words.row]
                out = []
                for width, repeats in plans:
                    for repeat in range(repeats):
                        out.append(_walk(hashes, in_item, ends, width, repeat, lambda k: used[_bit(k)])[2][-1])
                begin = np.concatenate([o[0] for o in out] or [np.zeros(0, np.int64)])
                key = np.concatenate([o[1] for o in out] or [np.zeros(0, np.uint64)])
                row = words.row[begin]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_key").take(pa.array(row)), pa.array(key.view(np.int64)),
                     pa.array((begin - words.first[row]).astype(np.int32))], ["row_key", "key", "at"])
    return run


def _best(item: list[int], text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any part of the text, and the end of that part."""
    row = np.zeros(len(text) + 1, np.int64)
    index = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - index) + index
    end = int(np.argmin(row))
    return int(row[end]), end


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                docs = Words(batch.column("text"), lower=True, separators=_SEPARATORS)
                items = Words(batch.column("item_text"), lower=True, separators=_SEPARATORS)
                doc_hash, item_hash, out = docs.hashes(), items.hashes(), []
                for i, marks in enumerate(batch.column("diagonals").to_pylist()):
                    item = item_hash[items.first[i]:items.first[i + 1]]
                    text = doc_hash[docs.first[i]:docs.first[i + 1]]
                    slack = int((1 - similarity) * len(item)) + 1
                    best, done = None, -len(item)
                    for mark in sorted(marks):
                        # diagonals so near that an earlier part covers them need no second look
                        if mark <= done:
                            continue
                        a = max(0, mark - 2 * slack)
                        b = min(len(text), mark + len(item) + 4 * slack)
                        done = mark + slack
                        # every edit spoils one item word at most
                        if np.isin(item, text[a:b]).sum() < similarity * len(item) - 1e-9:
                            continue
                        distance, end = _best(item.tolist(), text[a:b])
                        if best is None or distance < best[0]:
                            best = (distance, a + end)
                    if best and best[0] <= (1 - similarity) * len(item) + 1e-9:
                        out.append((batch.column("doc_id")[i].as_py(), batch.column("item_id")[i].as_py(),
                                    best[0], len(item), best[1]))
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["doc_id", "item_id", "distance", "item_words", "end_word"])
    return run


def drop_found(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without a benchmark item. Rows that share an id are one document; rows without
    an id are judged by their texts."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string")))
    unnamed = docs.filter("doc_id IS NULL").select(
        F.xxhash64(F.col("text").cast("string")).alias("doc_id"), "text")
    gone = find_items(docs.filter("doc_id IS NOT NULL"), benchmark, similarity).select(
        F.col("doc_id").alias("_id"), F.lit(None).cast("long").alias("_row"))
    gone = gone.union(find_items(unnamed, benchmark, similarity).select(F.lit(None).cast("long"), "doc_id")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & key.eqNullSafe(F.col("_row")), "left_anti")


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Benchmark items inside documents: doc_id, item_id, distance (edits between words),
    item_words, end_word (word after the best part), similarity. One row per pair."""
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropDuplicates()
    items = items.filter("text IS NOT NULL").withColumn("item", F.xxhash64("item_id", "text"))
    keys = settle(items.select("item", "text").mapInArrow(
        _item_keys(similarity), "item long, width int, repeat int, key long, item_at int"), "items")
    # a few widths
    plans = [tuple(r) for r in keys.groupBy("width").agg(F.max("repeat") + 1).orderBy("width").collect()]
    # at most 2**BITMAP numbers each, however large the benchmark
    word_bits = _bitmap(items.select("text").mapInArrow(_item_words, "bit long"))
    key_bits = _bitmap(items.select("text").mapInArrow(_item_bits(similarity), "bit long"))
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                         F.xxhash64("doc_id", "text").alias("row_key"))
    found = source.select("row_key", "text").mapInArrow(
        _doc_keys(plans, word_bits, key_bits), "row_key long, key long, at int")
    proposed = found.join(keys, "key").select(
        "row_key", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    pairs = proposed.groupBy("row_key", "item").agg(F.collect_set("diagonal").alias("diagonals"))
    pairs = settle(pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item"), "pairs")
    # the same join at every size: what is proposed grows with the documents
    checked = source.join(pairs.hint("merge"), "row_key").mapInArrow(
        _verify(similarity), "doc_id long, item_id long, distance long, item_words long, end_word long")
    best = checked.groupBy("doc_id", "item_id").agg(
        F.min_by(F.struct("distance", "item_words", "end_word"), F.struct("distance", "end_word")).alias("b"))
    return best.select(
        "doc_id", "item_id", "b.distance", "b.item_words", "b.end_word",
        (1 - F.col("b.distance") / F.col("b.item_words")).alias("similarity"))
