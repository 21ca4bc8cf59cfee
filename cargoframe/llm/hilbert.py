"""Sharding along a Hilbert curve over metadata dimensions, in DataFrame functions only.

Language, source and text length are quantised to ``BITS`` bits each; the cell's index on the
Hilbert curve orders the documents, so a shard is a run of the curve and covers a small range of
every dimension, which is what file pruning needs. Runs are cut where the shards' bytes are equal.

Equal texts are one group and stay in one shard. A group of more than ``1 / LARGE`` of a shard is
placed whole by its position on the curve, and the runs of the small groups are cut to the
room that leaves. Only a group larger than a shard is split.

Null texts count as empty, null languages and sources as a value of their own. Repeated rows
get a row each; equal (doc_id, text) rows take neighbouring slots. An empty table gives no row.
"""

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from cargoframe.sources.scratch import settle

BITS, LARGE = 6, 50


@functools.cache
def _curve(n: int) -> tuple[list[int], list[int]]:
    """Steps of the curve in n dimensions: for state * 2**n + cell the rank and the next state.

    A state is (entry corner, axis); ranks are Gray codes seen from it.
    """
    size, mask = 1 << n, (1 << n) - 1

    def turn(x: int, by: int) -> int:
        by %= n
        return (x << by | x >> (n - by)) & mask

    def gray(x: int) -> int:
        return x ^ x >> 1

    def ones_at_end(x: int) -> int:
        count = 0
        while x & 1:
            count, x = count + 1, x >> 1
        return count

    ranks, states = [], []
    for state in range(size * n):
        entry, axis = divmod(state, n)
        for cell in range(size):
            seen = turn(cell ^ entry, -(axis + 1))
            rank = next(r for r in range(size) if gray(r) == seen)
            corner = 0 if rank == 0 else gray(2 * ((rank - 1) // 2))
            side = 0 if rank == 0 else ones_at_end(rank - 1 if rank % 2 == 0 else rank) % n
            ranks.append(rank)
            states.append((entry ^ turn(corner, axis + 1)) * n + (axis + side + 1) % n)
    return ranks, states


def hilbert_index(dimensions: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell given by ints of ``bits`` bits."""
    n = len(dimensions)
    ranks, states = _curve(n)
    rank, state = F.array(*[F.lit(r) for r in ranks]), F.array(*[F.lit(s) for s in states])

    def step(acc: Column, level: Column) -> Column:
        cell = sum((F.shiftleft(F.getbit(d, level).cast("int"), j) for j, d in enumerate(dimensions[1:], 1)),
                   F.getbit(dimensions[0], level).cast("int"))
        at = acc["s"] * (1 << n) + cell
        return F.struct((acc["h"] * (1 << n) + F.get(rank, at)).alias("h"), F.get(state, at).alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(levels, start, step, lambda acc: acc["h"])


def _dimensions(docs: DataFrame) -> list[Column]:
    """Language and source by hash, length by its logarithm."""
    cells = 1 << BITS
    names = {c.lower() for c in docs.columns}
    by_name = [F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(cells)).cast("int") if c in names else F.lit(0)
               for c in ("source", "lang")]
    length = F.least(F.lit(cells - 1), F.floor(F.log2(F.length(F.coalesce("text", F.lit(""))) + 1.0) * 3)).cast("int")
    return [*by_name, length]


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless from 0
    within the shard, in curve order) and curve (the Hilbert index)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("tie"), hilbert_index(_dimensions(docs), BITS).alias("cell"))
    rows = settle(rows, "sizes")
    # a group lies at the least cell of its rows
    groups = rows.groupBy("tie", "text_crc32").agg(
        F.min("cell").alias("curve"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double")).first()[0]
    quota = max(total / shards, 1.0)
    files = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = settle(groups.repartitionByRange(files, "curve", "tie").withColumn("run", F.spark_partition_id()), "groups")
    big = (F.col("bytes") > quota / LARGE) & (F.col("bytes") <= quota)
    groups = groups.withColumn("big", big)

    def running(table: DataFrame, value: Column, name: str) -> DataFrame:
        """Bytes before every group along the curve: within its run, plus the runs before."""
        order = Window.partitionBy("run").orderBy("curve", "tie").rowsBetween(Window.unboundedPreceding, -1)
        runs = table.groupBy("run").agg(F.sum(value).alias("of_run"))
        before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row per run
        runs = F.broadcast(runs.select("run", F.coalesce(F.sum("of_run").over(before), F.lit(0)).alias("of_runs")))
        inside = F.coalesce(F.sum(value).over(order), F.lit(0))
        return table.withColumn("inside", inside).join(runs, "run").withColumn(
            name, F.col("of_runs") + F.col("inside")).drop("inside", "of_runs")

    along = running(groups, F.col("bytes"), "before")
    # at most shards * LARGE groups are big; each goes where its middle lies
    placed = along.filter("big").withColumn(
        "shard", F.least(F.floor((F.col("before") + F.col("bytes") / 2) / quota), F.lit(shards - 1)).cast("int"))
    placed = settle(placed.select("tie", "text_crc32", "curve", "bytes", "shard"), "placed")
    taken = {r["shard"]: float(r["b"]) for r in placed.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    over = [taken.get(s, 0.0) for s in range(shards)]
    room = [max(0.0, quota - o) for o in over]
    rest = total - sum(over)
    scale = rest / sum(room) if sum(room) else 0.0
    ends, end = [], 0.0
    for s in range(shards):
        end += room[s] * scale
        ends.append(end)

    def shard_of(middle: Column) -> Column:
        return F.least(sum((middle >= F.lit(e)).cast("int") for e in ends[:-1]) if shards > 1 else F.lit(0),
                       F.lit(shards - 1)).cast("int")

    small = running(groups.filter("NOT big"), F.col("bytes"), "before")
    keep = rows.select("doc_id", "size", "text_crc32", "tie")
    whole = small.filter(F.col("bytes") <= quota).withColumn(
        "shard", shard_of(F.col("before") + F.col("bytes") / 2)).select("tie", "text_crc32", "curve", "shard")
    whole = whole.union(placed.select("tie", "text_crc32", "curve", "shard"))
    settled = keep.join(whole, ["tie", "text_crc32"])
    # a group beyond a whole shard: its rows are dealt over the stretch of the curve that it fills
    huge = small.filter(F.col("bytes") > quota).select("tie", "text_crc32", "curve", "bytes", "before")
    spot = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    split = keep.join(F.broadcast(huge), ["tie", "text_crc32"]).withColumn(
        "shard", shard_of(F.col("before") + spot * F.col("bytes"))).select(*settled.columns)
    return _slots(settled.union(split))


def _slots(table: DataFrame) -> DataFrame:
    """Gapless slots within shards, in curve order, without gathering a shard in one task."""
    files = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(table.repartitionByRange(files, "shard", "curve", "tie", "doc_id")
                   .withColumn("run", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard and run
    counts = F.broadcast(counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    order = Window.partitionBy("shard", "run").orderBy("curve", "tie", "doc_id")
    return dealt.withColumn("place", F.row_number().over(order) - 1).join(counts, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"), "curve")
