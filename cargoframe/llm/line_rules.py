"""Quality rules: per-document statistics, and lines that many documents of a host share.

A line is normalised (ASCII lower case, words joined by one blank) and hashed. It is common
when more than ``MIN_DOCUMENTS`` documents of the host and more than ``MAX_SHARE`` of them hold
it (``MAX_SHORT_SHARE`` if it has fewer than ``SHORT_LINE`` words); equal texts count as one document, so copies do not make their own lines common. Common
lines are removed, and a document that keeps less than ``MIN_LEFT`` of its words is rejected.

Null and empty texts have no word and fail the base rule. A null host is a host of its own.
Repeated rows are judged alike, one result row each. An empty table gives no row.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cargoframe.llm.words import Words, lists, mix, signed
from cargoframe.sources.scratch import settle, ship

MIN_DOCUMENTS, MAX_SHARE, MIN_LEFT = 10, 0.01, 0.5
#: Lines of fewer words may recur by chance and have a share of their own.
SHORT_LINE, MAX_SHORT_SHARE = 4, 0.1
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_DIGEST = ("doc_id long, host string, row_hash long, n_words long, word_chars long, n_symbols long, "
           "n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words per row inside 3-word windows found twice or more in the row."""
    at, gram = words.grams(hashes, 3)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        key = mix(gram ^ mix(words.row[at].astype(np.uint64)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[inverse] > 1]
        for j in range(3):
            covered[twice + j] = 1
    return _sums(covered[:-1], words.first)


def _lines(column: pa.Array, words: Words, hashes: np.ndarray, lowered: np.ndarray):
    """Lines with a word: row, exact hash, normalised hash and number of words."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = ends - (data[ends - 1] == 10)
    first = np.searchsorted(words.starts, starts)
    count = np.searchsorted(words.starts, ends) - first
    with_word = count > 0
    starts, ends, first, count = starts[with_word], ends[with_word], first[with_word], count[with_word]
    row = np.searchsorted(offsets, starts, side="right") - 1
    if not len(starts):
        return row, np.zeros(0, np.uint64), np.zeros(0, np.uint64), count
    within = (np.arange(len(hashes)) - np.repeat(first, count)).astype(np.uint64)
    normal = mix(np.add.reduceat(mix(lowered + mix(within)), first))
    exact = np.array([hash(data[a:b].tobytes()) for a, b in zip(starts, ends)], np.int64).view(np.uint64)
    return row, exact, normal, count


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, 2000):
            batch = whole.slice(low, 2000)
            text = batch.column("text")
            words = Words(text)
            hashes = words.hashes()
            lowered = Words(text, lower=True).hashes()
            row, exact, normal, count = _lines(text, words, hashes, lowered)
            # a line equal to an earlier one of its row
            order = np.lexsort((np.arange(len(row)), exact, row))
            again = np.zeros(len(row), np.int64)
            same = (row[order][1:] == row[order][:-1]) & (exact[order][1:] == exact[order][:-1])
            again[order[1:][same]] = 1
            n = batch.num_rows
            per_row = np.bincount(row, minlength=n)
            total = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])  # code points
            chars = total[words.ends] - total[words.starts]
            struct = pa.StructArray.from_arrays([signed(normal), pa.array(count.astype(np.int32))], ["line", "words"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("host"), batch.column("row_hash"),
                pa.array(words.counts.astype(np.int64)), pa.array(_sums(chars, words.first)),
                pa.array(_sums(_SYMBOL[words.data], words.offsets)),
                pa.array(np.bincount(row, weights=again, minlength=n).astype(np.int64)),
                pa.array(_repeated(words, hashes)), lists(struct, per_row),
            ], ["doc_id", "host", "row_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                "n_repeat_words", "lines"])


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_common_words (words in common lines), kept."""
    ship(docs.sparkSession)
    source = docs.select(
        F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"),
        F.col("text").cast("string"), F.xxhash64("text").alias("row_hash"))
    digest = source.mapInArrow(_digest, _DIGEST).withColumn("row", F.monotonically_increasing_id())
    digest = settle(digest, "lines")
    lines = digest.select("row", "host", "row_hash", F.explode("lines").alias("l")).select(
        "row", "host", "row_hash", "l.line", "l.words")
    sizes = digest.groupBy("host").agg(F.count_distinct("row_hash").alias("documents"))
    common = (
        lines.groupBy("host", "line").agg(F.count_distinct("row_hash").alias("holders"), F.max("words").alias("words"))
        .filter(F.col("holders") > MIN_DOCUMENTS)
        .join(sizes.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
        .filter(F.col("holders") > F.when(F.col("words") < SHORT_LINE, MAX_SHORT_SHARE).otherwise(MAX_SHARE)
                * F.col("documents"))
        .select(F.col("host").alias("common_host"), F.col("line").alias("common_line"))
    )
    removed = (
        lines.join(common, F.col("host").eqNullSafe(F.col("common_host")) & (F.col("line") == F.col("common_line")))
        .groupBy("row").agg(F.sum("words").cast("long").alias("n_common_words"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = digest.drop("lines").join(removed, "row", "left").withColumn(
        "n_common_words", F.coalesce("n_common_words", F.lit(0))).withColumn("base_failed", failed)
    left = F.col("n_words") - F.col("n_common_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_LEFT * F.col("n_words"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_common_words", "kept")
