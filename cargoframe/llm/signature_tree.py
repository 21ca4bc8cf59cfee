"""Exact Jaccard self-join of documents on word shingles, by signature trees.

Equal sets are one *class* (64-bit key of the set). All shingles have one fixed order, rare ones
first: by the level of their cell in a count sketch of ``CELLS`` cells, then by hash. Of two linked
sets the first common shingle lies in the prefix of both, since neither can spare more than
``size - num / den * size`` shingles before it; any fixed order is exact, and rare ones first keep
a passage that many documents share out of the prefixes. The trees over the classes have these levels:

1. a tree per shingle, over the sets that hold it in their prefix;
2. inner nodes: sets of like size and like place of the shingle;
3. leaves: the members of an inner node that are known to be in one component.

Inner nodes and leaves hold the OR of their members' token bitmaps, their size range and the most
shingles a member has from the tree's shingle on. First every set is compared with the most central
member of its trees (the one with the fewest rarer shingles). Verified links give components, and
trees with different components are traversed from their inner nodes down, in pairs: a pair
goes where sizes or the largest possible overlap (common bits of the bitmaps plus shingles that share a
bit; shingles from the tree's one on, as a linked pair meets at its first common one) rule a link
out, or where all is in one component already. What remains is verified on the whole sets.
Copies thus never become pairs, no link is lost and no cap is set on partners.

Null and empty texts have an empty set and link with nothing. Repeated rows and ids give one
result row per input row. Null ids count as the largest; a component of null ids only is null.
An empty table gives no row. Columns other than doc_id and text are neither read nor changed.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cargoframe.llm.components import components
from cargoframe.llm.words import Words, buffers, free_names, lists, mix, packed_texts, signed, unpacked
from cargoframe.sources.scratch import place, remove, settle, ship

ROWS, PIECE = 1000, 1 << 20  # rows and bytes of text handled at once
LANES = 8  # 64-bit words of a token bitmap
CELLS = 1 << 18  # of the count sketch that orders shingles by rarity
PARTS = 16  # rows that a sketch travels in
_BITS = [f"b{j}" for j in range(LANES)]  # OR of the shingles' bits
_ODD = [f"x{j}" for j in range(32)]  # XOR of the bits in a wider map
SPOTS = 1 << 20  # residues of keys, the most that a broadcast filter holds


class Sets:
    """Distinct shingles of the rows of a batch: ``values`` sorted within ``first[i]:first[i + 1]``."""

    def __init__(self, column: pa.Array, k: int):
        words = Words(column, lower=True)
        hashes = words.hashes()
        at, gram = words.grams(hashes, k)
        row = words.row[at]
        short = np.flatnonzero((words.counts > 0) & (words.counts < k))
        if len(short):  # the whole sequence is the only shingle
            extra = []
            for i in short:
                total = np.uint64(0)
                for h in hashes[words.first[i]:words.first[i + 1]]:
                    total = mix(np.array([total ^ h]))[0] + np.uint64(1)
                extra.append(total ^ np.uint64(words.counts[i]))
            gram, row = np.concatenate([gram, np.array(extra, np.uint64)]), np.concatenate([row, short])
        order = np.lexsort((gram, row))
        gram, row = gram[order], row[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        self.values, self.row = gram[fresh], row[fresh]
        self.size = np.bincount(self.row, minlength=len(column))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.values), dtype=np.uint64)])
        self.key = mix((total[self.first[1:]] - total[self.first[:-1]]) ^ mix(self.size.astype(np.uint64)))


def _cell(values: np.ndarray) -> np.ndarray:
    return (mix(values) >> np.uint64(32)) % np.uint64(CELLS)


def _prefixes(sets: Sets, num: int, den: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and place of the rarest shingles of every set; one row speaks for its equals."""
    once = np.zeros(len(sets.size), bool)
    once[np.unique(sets.key, return_index=True)[1]] = True
    at = np.flatnonzero(once[sets.row])
    values, row = sets.values[at], sets.row[at]
    # values ascend within a row and the sort is stable, so the order is (level, value)
    rank = (levels[_cell(values)].astype(np.uint64) << np.uint64(56)) | (values >> np.uint64(8))
    order = np.lexsort((rank, row))
    size = np.where(once, sets.size, 0)
    place = np.arange(len(order)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    least = -(-size * num // den)  # shingles a linked set shares at least
    keep = place <= (size - least)[row[order]]
    return row[order][keep], values[order][keep], place[keep]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``ROWS`` rows and ``PIECE`` bytes of text, or of one longer text."""
    for batch in batches:
        if "size" in batch.schema.names:
            ends = np.cumsum(batch.column("size").fill_null(0).to_numpy(zero_copy_only=False))
        else:
            ends = buffers(batch.column("text"))[1][1:]
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = min(max(low + 1, int(np.searchsorted(ends, before + PIECE, side="right"))), low + ROWS)
            yield batch.slice(low, high - low)
            low = high


def _classes(k: int):
    """The class of every row; after the last one of a task, its share of the count sketch."""
    def run(batches):
        counts = np.zeros(CELLS, np.uint32)
        names = ["doc_id", "row", "n_shingles", "key", "part", "counts"]
        for batch in _batches(batches):
            sets = Sets(batch.column("text"), k)
            once = np.zeros(len(sets.size), bool)
            once[np.unique(sets.key, return_index=True)[1]] = True
            counts += np.bincount(_cell(sets.values[once[sets.row]]).astype(np.int64), minlength=CELLS).astype(np.uint32)
            none = [pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(sets.size.astype(np.int64)), signed(sets.key),
                 *none], names)
        if counts.any():
            nulls = [pa.nulls(PARTS, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(
                [*nulls, pa.array(range(PARTS), pa.int32()),
                 pa.array([part.tobytes() for part in np.split(counts, PARTS)], pa.binary())], names)
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of the tasks, added up by part as they come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            own = np.frombuffer(counts, np.uint32).astype(np.int64)
            total[part] = total[part] + own if part in total else own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["part", "counts"])


def _levels(sketch: DataFrame) -> np.ndarray:
    """Logarithmic level of every cell (``CELLS`` bytes), for all tasks."""
    counts = np.zeros((PARTS, CELLS // PARTS), np.int64)
    for row in sketch.repartition(PARTS, "part").mapInArrow(_added, "part int, counts binary").collect():
        counts[row.part] += np.frombuffer(row.counts, np.int64)
    return np.floor(4 * np.log2(counts.ravel() + 1)).astype(np.uint8)


def _nodes(k: int, num: int, den: int, levels: np.ndarray):
    def run(batches):
        for batch in _batches(batches):
            sets = Sets(batch.column("text"), k)
            row, shingle, place = _prefixes(sets, num, den, levels)
            yield pa.RecordBatch.from_arrays(
                [signed(shingle), signed(sets.key[row]), pa.array(sets.size[row].astype(np.int32)),
                 pa.array((sets.size[row] - place).astype(np.int32))], ["node", "key", "size", "rest"])
    return run


def _whole_sets(k: int):
    def run(batches):
        for batch in _batches(batches):
            sets = Sets(unpacked(batch), k)
            bits = np.zeros((batch.num_rows, LANES), np.uint64)
            spot = sets.values % np.uint64(64 * LANES)
            np.bitwise_or.at(bits, (sets.row, (spot >> np.uint64(6)).astype(np.int64)),
                             np.uint64(1) << (spot & np.uint64(63)))
            odd = np.zeros((batch.num_rows, len(_ODD)), np.uint64)
            spot = sets.values % np.uint64(64 * len(_ODD))
            np.bitwise_xor.at(odd, (sets.row, (spot >> np.uint64(6)).astype(np.int64)),
                              np.uint64(1) << (spot & np.uint64(63)))
            yield pa.RecordBatch.from_arrays(
                [signed(sets.key), pa.array(sets.size.astype(np.int64)), lists(signed(sets.values), sets.size),
                 *[signed(np.ascontiguousarray(maps[:, j])) for maps in (bits, odd) for j in range(maps.shape[1])]],
                ["key", "size", "shingles", *_BITS, *_ODD])
    return run


def _verify(num: int, den: int):
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(low, 256) for low in range(0, whole.num_rows, 256)):
                keep = []
                for i in range(batch.num_rows):
                    a = batch.column("left_set")[i].values.to_numpy()
                    b = batch.column("right_set")[i].values.to_numpy()
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(den * common >= num * (len(a) + len(b) - common))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return run


def _ones(left: str, right: str):
    return sum((F.bit_count(F.col(f"{left}.{b}").bitwiseAND(F.col(f"{right}.{b}"))) for b in _BITS[1:]),
               F.bit_count(F.col(f"{left}.{_BITS[0]}").bitwiseAND(F.col(f"{right}.{_BITS[0]}"))))


def _may_link(left: str, right: str, num: int, den: int, *bounds):
    """Neither the size ranges nor the largest possible overlap exclude a link; ``bounds`` limit it too."""
    most = _ones(left, right) + F.least(F.col(f"{left}.slack"), F.col(f"{right}.slack"))
    most = F.least(most, *bounds) if bounds else most
    return _ranges(left, right, num, den) & _enough(most, F.col(f"{left}.low"), F.col(f"{right}.low"), num, den)


def _ranges(left: str, right: str, num: int, den: int):
    """Some sizes of both ranges allow a link."""
    return (den * F.col(f"{left}.high") >= num * F.col(f"{right}.low")) & (
        den * F.col(f"{right}.high") >= num * F.col(f"{left}.low"))


def _from_here(left: str, right: str):
    """Shingles from the tree's one on: at the first common shingle no more can be common."""
    return F.least(F.col(f"{left}.rest"), F.col(f"{right}.rest"))


def _few_differ(left: str, right: str, num: int, den: int):
    """Bits that differ in the parities of two sets stand for as many shingles of one set only."""
    differ = sum((F.bit_count(F.col(f"{left}.{x}").bitwiseXOR(F.col(f"{right}.{x}"))) for x in _ODD[1:]),
                 F.bit_count(F.col(f"{left}.{_ODD[0]}").bitwiseXOR(F.col(f"{right}.{_ODD[0]}"))))
    return (den + num) * differ <= (den - num) * (F.col(f"{left}.low") + F.col(f"{right}.low"))


def _sizes(a, b, num: int, den: int):
    return (den * a >= num * b) & (den * b >= num * a)


def _enough(common, a, b, num: int, den: int):
    return (den + num) * common >= num * (a + b)


def _apart(left: str, right: str):
    """The two sides are not wholly inside one component."""
    return ~((F.col(f"{left}.least") == F.col(f"{left}.most")) & (F.col(f"{left}.least") == F.col(f"{right}.least"))
             & (F.col(f"{right}.least") == F.col(f"{right}.most")))


def _head() -> list:
    """What an inner entry keeps of its members: OR of the bitmaps, sizes, components."""
    return [F.min("low").alias("low"), F.max("high").alias("high"), F.max("slack").alias("slack"), F.max("rest").alias("rest"),
            F.min("least").alias("least"), F.max("most").alias("most"), *[F.bit_or(b).alias(b) for b in _BITS]]


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) of classes that do link, by their whole sets.

    Only sets whose key may be in a pair, by at most ``SPOTS`` residues, enter the joins.
    """
    pairs = settle(pairs, "pairs")

    def whole(name: str, values: str) -> DataFrame:
        spots = pairs.select(F.pmod(name, F.lit(SPOTS)).alias("spot")).distinct()
        return sets.withColumn("spot", F.pmod("key", F.lit(SPOTS))).join(F.broadcast(spots), "spot", "left_semi").select(
            F.col("key").alias(name), F.col("shingles").alias(values))

    left, right = whole("u", "left_set"), whole("v", "right_set")
    return pairs.join(left, "u").join(right, "v").mapInArrow(_verify(num, den), "u long, v long")


def _pruned(pairs: DataFrame, leaf: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that sizes and bitmaps of both sets allow to link."""
    return (pairs.join(leaf.select(F.col("key").alias("u"), F.col("s").alias("left")), "u")
            .join(leaf.select(F.col("key").alias("v"), F.col("s").alias("right")), "v")
            .filter(_may_link("left", "right", num, den) & _few_differ("left", "right", num, den)).select("u", "v"))


def _row():
    """Hash of the id and the text of a row, which rows without an id have too."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def link_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id, row (hash of id and text), n_shingles, key of every row; and linked pairs (u, v) of keys that
    connect what the join connects: den * |intersection| >= num * |union|."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _row().alias("row"))
    classes = settle(source.mapInArrow(
        _classes(k), "doc_id long, row long, n_shingles long, key long, part int, counts binary"), "classes")
    members = classes.filter("part IS NULL").drop("part", "counts")
    levels = _levels(classes.filter("part IS NOT NULL").select("part", "counts"))
    spark = docs.sparkSession
    path = place(spark, "prefixes")
    source.select("text").mapInArrow(
        _nodes(k, num, den, levels), "node long, key long, size int, rest int").write.parquet(path)
    # one exchange serves the roots and their members; a root needs two sets, one of which (the
    # smaller of a linked pair) has the shingle among its first ones
    nodes = spark.read.schema("node long, key long, size int, rest int").parquet(path).repartition("node")
    roots = nodes.groupBy("node").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.max((den + num) * F.col("rest") >= 2 * num * F.col("size")).alias("early"))
    place_of = F.floor((F.col("size") - F.col("rest")) * 40 / F.col("size"))
    held = settle(nodes.join(roots.filter("low < high AND early").select("node"), "node").distinct().withColumn(
        "inner", (F.floor(F.log2("size") * 8) * 64 + place_of).cast("int")), "nodes")
    remove(spark, path)
    # inner nodes that sizes and places allow to link with one of their tree
    spans = held.groupBy("node", "inner").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.max("rest").alias("rest"), F.count("*").alias("n"))
    span = F.struct("low", "high", "rest")
    alive = spans.select("node", "inner", "n", span.alias("left")).join(
        spans.select("node", F.col("inner").alias("other"), span.alias("right")), "node").filter(
        ((F.col("inner") != F.col("other")) | (F.col("n") > 1)) & _ranges("left", "right", num, den)
        & _enough(_from_here("left", "right"), F.col("left.low"), F.col("right.low"), num, den)).select("node", "inner").distinct()
    held = settle(held.join(alive, ["node", "inner"]), "alive")
    first = members.join(held.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    packed = source.select("row", "text").mapInArrow(packed_texts, "row long, packed binary, size long")
    sets = settle(packed.join(first.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]).select("packed", "size")
                  .mapInArrow(_whole_sets(k), "key long, size long, shingles array<long>, "
                              + ", ".join(f"{b} long" for b in _BITS + _ODD)), "sets")
    ones = sum((F.bit_count(b) for b in _BITS[1:]), F.bit_count(_BITS[0]))
    leaf = sets.select("key", F.struct(
        F.col("size").alias("low"), F.col("size").alias("high"), (F.col("size") - ones).alias("slack"), *_BITS, *_ODD).alias("s"))
    # every set against the most central member of its trees: the one that most of them have, so one pair per set
    heads = held.groupBy("node").agg(F.min(F.struct(
        (F.col("size") - F.col("rest")).alias("place"), "key", "size", "rest")).alias("head"))
    near = held.join(heads, "node").filter(F.col("key") != F.col("head.key")).filter(
        _sizes(F.col("size"), F.col("head.size"), num, den)
        & _enough(F.least("rest", "head.rest"), F.col("size"), F.col("head.size"), num, den))
    star = near.groupBy(F.col("key").alias("v"), F.col("head.key").alias("u")).agg(F.count("*").alias("n")).groupBy("v").agg(
        F.max_by("u", F.struct("n", "u")).alias("u"))
    star = settle(star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "star")
    links = settle(_checked(_pruned(star, leaf, num, den), sets, num, den), "links")
    groups = components(links).withColumnRenamed("node", "key")
    # trees that still hold different components, from their inner nodes down
    named = settle(held.join(groups, "key", "left").withColumn("component", F.coalesce("component", "key")), "named")
    kinds = named.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    member = settle(named.join(kinds.filter("low < high").select("node"), "node"), "members")
    leaves = settle(member.join(leaf, "key").select(
        "node", "inner", "rest", F.col("component").alias("least"), F.col("component").alias("most"), "s.*").groupBy(
        "node", "inner", F.col("least").alias("component")).agg(*_head()), "leaves")
    inner = leaves.groupBy("node", "inner").agg(*_head())
    entry = F.struct(*[c for c in inner.columns if c not in ("node", "inner")])

    def meet(pairs: DataFrame) -> DataFrame:
        return pairs.filter(_may_link("left", "right", num, den, _from_here("left", "right")) & _apart("left", "right"))

    pairs = meet(inner.select("node", "inner", entry.alias("left")).join(
        inner.select("node", F.col("inner").alias("other"), entry.alias("right")), "node").filter(
        "inner <= other")).select("node", "inner", "other")
    pairs = meet(pairs.join(leaves.select("node", "inner", F.col("component").alias("of_a"), entry.alias("left")), ["node", "inner"])
                 .join(leaves.select("node", F.col("inner").alias("other"), F.col("component").alias("of_b"),
                                     entry.alias("right")), ["node", "other"])
                 .filter("of_a <> of_b AND (inner < other OR of_a < of_b)")).select("node", "inner", "of_a", "other", "of_b")
    a = member.select("node", "inner", F.col("component").alias("of_a"), F.col("key").alias("a"),
                      F.col("size").alias("size_a"), F.col("rest").alias("rest_a"))
    b = member.select("node", F.col("inner").alias("other"), F.col("component").alias("of_b"), F.col("key").alias("b"),
                      F.col("size").alias("size_b"), F.col("rest").alias("rest_b"))
    rest = pairs.join(a, ["node", "inner", "of_a"]).join(b, ["node", "other", "of_b"]).filter(
        _sizes(F.col("size_a"), F.col("size_b"), num, den)
        & _enough(F.least("rest_a", "rest_b"), F.col("size_a"), F.col("size_b"), num, den))
    rest = rest.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().join(
        star, ["u", "v"], "left_anti")
    more = _checked(_pruned(rest, leaf, num, den), sets, num, den)
    return members, settle(links.union(more), "links")


def _judged(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``near_duplicates`` with row and least_row, the least row of a component's null ids."""
    members, links = link_classes(docs, k, num, den)
    groups = components(links).withColumnRenamed("node", "key")
    joined = members.join(groups, "key", "left").withColumn("component", F.coalesce("component", "key"))
    filled = joined.filter("n_shingles > 0")
    least = filled.groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.min(F.when(F.col("doc_id").isNull(), F.col("row"))).alias("least_row"))
    linked = filled.join(least, "component").select("doc_id", "n_shingles", "component_id", "row", "least_row")
    return linked.union(joined.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row", F.col("row").alias("least_row")))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    return _judged(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with one of each near-duplicate group left: the one with the least doc_id.

    Rows that share an id are one document, without an id those that share the text; of a group
    without any id the text with the least hash stays. Documents without a shingle all stay.
    """
    an_id, a_row = free_names(docs, "id", "row")
    gone = _judged(docs, k, num, den).filter("n_shingles > 0").filter(
        "doc_id <> component_id OR (doc_id IS NULL AND (component_id IS NOT NULL OR row <> least_row))").select(
        F.col("doc_id").alias(an_id), F.when(F.col("doc_id").isNull(), F.col("row")).alias(a_row)).distinct()
    own = F.when(F.col("doc_id").isNull(), _row())
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(an_id)) & own.eqNullSafe(F.col(a_row)), "left_anti")
