"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``window`` consecutive words the least hash among its
``ANCHOR``-word grams (the rightmost of equals). The choice depends on the window's words alone,
so equal windows have equal anchors at equal places, and a window that repeats elsewhere is
found through its anchor. Places are dealt by anchor into buckets; where an anchor meets itself,
its place is extended both ways over the windows that chose it, and a window that a smaller
document holds too marks its words. Runs of marked words are the maximal repeats.

No pair of documents is formed. Inside a batch of documents a window stays with its smallest
document only, the others are marked at once; so a passage in a third of all rows costs a bucket
one place per batch. The number of buckets grows with the bytes of text (``BUCKET`` each). Windows
are compared by bucket, 32 bits of their anchor's hash and 48 bits of their own. ``window`` is
below 32,768 words.

Null and empty texts have no word. Rows with the same id are one document for the comparison
and get one result row each. Null ids count as smaller than any other and among themselves as
one document. An empty table gives no row.
"""

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from cargoframe.llm.words import Words, lists, mix, packed_texts, unpacked
from cargoframe.sources.scratch import ship

ANCHOR = 6
ROWS = 1000
BUCKET = 1 << 22  # bytes of text
BUCKETS = 1024  # at least
LONGEST = 32_000  # windows of one run
_PLACES = ("bucket long, anchor array<int>, text_hash array<long>, doc array<long>, first array<int>, "
           "n array<smallint>, low array<int>, high array<smallint>")


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all whole windows, the gram start each chose, and the gram hashes by start."""
    hashes = words.hashes()
    size = min(ANCHOR, window)
    at, gram = words.grams(hashes, size)
    dense = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
    dense[at] = gram
    whole, _ = words.grams(hashes, window)
    best, place = dense[whole] if len(whole) else np.zeros(0, np.uint64), whole.copy()
    for j in range(1, window - size + 1):
        other = dense[whole + j]
        take = other <= best
        best = np.where(take, other, best)
        place = np.where(take, whole + j, place)
    return whole, place, dense


def _later(anchor: np.ndarray, gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Windows that a smaller document holds as well."""
    order = np.lexsort((doc, gram, anchor))
    anchor, gram, doc = anchor[order], gram[order], doc[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (gram[1:] != gram[:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = doc > doc[head]
    return out


def _runs(first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs of consecutive window starts with one owner."""
    fresh = np.ones(len(first), bool)
    fresh[1:] = (first[1:] != first[:-1] + 1) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(fresh)
    return begin, np.diff(np.concatenate([begin, [len(first)]]))


def _places(bucket, counts, anchor, text_hash, doc, first, n, gram, grams) -> pa.RecordBatch:
    """Rows of places, ``counts`` places and ``grams`` windows each."""
    anchor = (anchor >> np.uint64(32)).astype(np.uint32).view(np.int32)
    low, high = gram.astype(np.uint32).view(np.int32), (gram >> np.uint64(48)).astype(np.uint16).view(np.int16)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket.astype(np.int64)), lists(pa.array(anchor), counts if len(anchor) else 0 * counts),
         lists(pa.array(text_hash), counts), lists(pa.array(doc), counts), lists(pa.array(first.astype(np.int32)), counts),
         lists(pa.array(n.astype(np.int16)), counts), lists(pa.array(low), grams), lists(pa.array(high), grams)],
        ["bucket", "anchor", "text_hash", "doc", "first", "n", "low", "high"])


def _seeds(window: int, buckets: int):
    """Places per bucket; a row without anchors holds places that are marked already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for whole_batch in batches:
            for low in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(low, ROWS)
                docs, texts = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy()
                # equal rows share their marks
                batch = batch.take(pa.array(np.unique(np.stack([docs, texts]), axis=1, return_index=True)[1]))
                docs, texts = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy()
                words = Words(batch.column("text"))
                whole, place, dense = _anchors(words, window)
                if not len(whole):
                    continue
                anchor, gram = dense[place], words.grams(words.hashes(1), window)[1]
                row = words.row[whole]
                doc, first = docs[row], whole - words.first[row]
                later = _later(anchor, gram, doc)
                at = np.flatnonzero(later)
                if len(at):
                    begin, n = _runs(first[at], row[at] << 32 | first[at] // LONGEST)
                    at = at[begin]
                    yield _places(np.abs(texts[row[at[:1]]] % buckets), np.array([len(at)]), none, texts[row[at]], doc[at],
                                  first[at], n, none, np.zeros(1, np.int64))
                rest = np.flatnonzero(~later)
                begin, n = _runs(first[rest], place[rest])
                at = rest[begin]
                bucket = (mix(anchor[at]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                at, begin, n, bucket = at[order], begin[order], n[order], bucket[order]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                inside = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield _places(bucket[edge], np.diff(np.concatenate([edge, [len(at)]])), anchor[at], texts[row[at]], doc[at],
                              first[at], n, gram[rest][inside], np.add.reduceat(n, edge))
    return run


def _extend(places: pa.Table) -> pa.Table:
    """Marked runs of one bucket: the windows around its anchors that a smaller document holds too."""
    def flat(name: str, rows: pa.Table) -> np.ndarray:
        return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    open_ = pa.compute.greater(pa.compute.list_value_length(places.column("anchor")), 0)
    known, rows = places.filter(pa.compute.invert(open_)), places.filter(open_)
    anchor, text, doc, first, n = (flat(c, rows) for c in ("anchor", "text_hash", "doc", "first", "n"))
    gram = flat("high", rows).astype(np.int64) << 32 | flat("low", rows).view(np.uint32)
    of = np.repeat(np.arange(len(n)), n)
    start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(_later(anchor[of], gram, doc[of]))
    begin, size = _runs(start[at], of[at])
    at = at[begin]
    return pa.table({
        "doc": np.concatenate([doc[of[at]], flat("doc", known)]),
        "text_hash": np.concatenate([text[of[at]], flat("text_hash", known)]),
        "first": np.concatenate([start[at], flat("first", known)]).astype(np.int32),
        "n": np.concatenate([size, flat("n", known)]).astype(np.int32)})


def _cover(words: Words, marks: pa.Array, window: int) -> np.ndarray:
    """Words that a marked window covers."""
    marks = marks.fill_null(pa.scalar([], marks.type)) if marks.null_count else marks
    row = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
    runs = marks.flatten()
    at = words.first[row] + runs.field("first").to_numpy(zero_copy_only=False)
    step = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + runs.field("n").to_numpy(zero_copy_only=False) + (window - 1), -1)
    return np.cumsum(step)[:-1] > 0


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for low in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(low, ROWS)
                column = unpacked(batch)
                words = Words(column)
                gone = _cover(words, batch.column("places"), window)
                kept, digest, removed, spans = [], [], [], []
                for i in range(batch.num_rows):
                    a, b = words.first[i], words.first[i + 1]
                    dead, start, end = gone[a:b], words.starts[a:b], words.ends[a:b]
                    text = words.data[words.offsets[i]:words.offsets[i + 1]].tobytes()
                    shift = words.offsets[i]
                    removed.append(int(dead.sum()))
                    left = b" ".join(text[s - shift:e - shift] for s, e in zip(start[~dead], end[~dead])) \
                        if removed[-1] else b" ".join(text.split())
                    digest.append(hashlib.sha256(left).hexdigest())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], dead.astype(np.int8), [0]])))
                    spans.append(edge.astype(np.int32).reshape(-1, 2))
                    if removed[-1]:
                        # cut from the first removed word to the next kept one
                        pieces, low_byte = [], 0
                        for first, last in spans[-1]:
                            pieces.append(text[low_byte:start[first] - shift])
                            low_byte = (start[last] - shift) if last < len(start) else len(text)
                        text = b"".join([*pieces, text[low_byte:]])
                    kept.append(text)
                flat = np.concatenate([*spans, np.zeros((0, 2), np.int32)])
                struct = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["first", "end"])
                null = column.is_null()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("carried"), batch.column("text_hash"),
                     pa.array(words.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
                     pa.array([None if n else k.decode("utf-8", "surrogatepass") for n, k in zip(null.to_pylist(), kept)], pa.string()),
                     lists(struct, np.array([len(s) for s in spans], np.int64))],
                    ["doc_id", "carried", "text_hash", "n_words", "n_removed", "kept_sha256", "kept_text", "repeats"])
    return run


def remove_repeats(docs: DataFrame, window: int = 13, carry: Sequence[str] = ()) -> DataFrame:
    """Remove every word inside a ``window`` of words that also starts in a document with a
    smaller doc_id. One row per input row: doc_id, text_hash, n_words, n_removed, kept_sha256
    (kept words joined by one blank), kept_text (the text without the repeats, its white space
    otherwise as it was) and repeats (first and end word of every maximal repeat). Columns named in
    ``carry`` travel with the text, so no join back to ``docs`` is needed: they come first, as the
    fields of a struct ``carried``.
    """
    ship(docs.sparkSession)
    least = -(1 << 63)
    source = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc"),
        F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"),
        (F.struct(*carry) if carry else F.lit(None).cast("int")).alias("carried"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = source.select("doc", "text_hash", "text").mapInArrow(_seeds(window, max(BUCKETS, size // BUCKET)), _PLACES)
    runs = places.groupBy("bucket").applyInArrow(_extend, "doc long, text_hash long, first int, n int")
    marks = runs.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("first", "n")).alias("places"))
    # the texts are shuffled this once, and whatever else of a row is wanted goes with them
    fields = StructType().add("doc_id", "long").add("carried", source.schema["carried"].dataType)
    packed = source.select("doc_id", "carried", "doc", "text_hash", "text").mapInArrow(packed_texts, _and(
        fields, "doc long, text_hash long, packed binary, size long"))
    marked = packed.join(marks, ["doc", "text_hash"], "left").select(
        "doc_id", "carried", "text_hash", "packed", "size", "places")
    out = marked.mapInArrow(_remove(window), _and(
        fields, "text_hash long, n_words long, n_removed long, kept_sha256 string, "
                "kept_text string, repeats array<struct<first:int,end:int>>"))
    return out.select("carried", *(c for c in out.columns if c != "carried")) if carry else out.drop("carried")


def _and(fields: StructType, more: str) -> StructType:
    return StructType([*fields.fields, *StructType.fromDDL(more).fields])
