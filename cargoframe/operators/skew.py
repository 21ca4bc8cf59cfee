"""Group work that survives one key holding a large share of all rows.

A key is *hot* when it holds more than ``HOT_ROWS`` rows and more than one part in
``MAX_HOT_KEYS`` of the frame, so there are never more than ``MAX_HOT_KEYS`` hot keys:
anything with one row per hot key may be broadcast. Cold groups use ordinary windows,
hot groups use partial aggregates that are joined back without moving their rows.
When no key is hot, adaptive execution drops the hot branch after the count.
"""

import tempfile
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate results; a temporary one on local[n]."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that lost executors do not matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    fair = counts.agg((F.sum("_rows") / F.lit(float(MAX_HOT_KEYS))).alias("_fair"))
    limit = F.greatest(F.lit(float(hot_rows)), F.coalesce("_fair", F.lit(0.0)))
    return counts.crossJoin(F.broadcast(fair)).filter(F.col("_rows") > limit).select(*keys)


def split_hot(
    df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(cold, hot) parts of the frame; rows with a NULL key are cold."""
    hot = F.broadcast(hot_keys(df, keys, hot_rows))
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def join_unique(
    rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join rows to a frame with one row per key; hot keys of ``rows`` are not shuffled."""
    hot = F.broadcast(hot_keys(rows, keys, hot_rows))
    cold = rows.join(hot, keys, "left_anti").join(side, keys, how)
    few = F.broadcast(side.join(hot, keys, "left_semi"))
    return cold.unionByName(rows.join(hot, keys, "left_semi").join(few, keys, how))


# Ordered work without a sort of the whole frame -----------------------------------------

#: Keys sampled for each range boundary, and the most ranges.
SAMPLED, RANGES = 64, 1024
#: A total order: (column, "asc" or "desc"), NULLs last.
Order = list[tuple[str, str]]


def order_by(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if way == "desc" else F.asc_nulls_last(c) for c, way in order]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def boundaries(df: DataFrame, order: Order) -> list[Row]:
    """Keys that cut the frame into about equal ranges, as many as there are shuffle partitions
    (``RANGES`` at most, which bounds the expression that finds a row's range).

    They come from the keys of smallest hash, a sample of bounded size that does not depend
    on how the rows are partitioned.
    """
    ranges, keys = min(_parts(df), RANGES), [c for c, _ in order]
    sample = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(SAMPLED * ranges)
    found = sample.orderBy(*order_by(order)).collect()  # at most SAMPLED * ranges keys
    step = max(1, -(-len(found) // ranges))
    return list(dict.fromkeys(found[step::step]))


def _reached(bound: Row, order: Order, kinds: list[T.DataType]) -> Column:
    """The row lies at the bound or behind it."""
    reached = F.lit(True)
    for (name, way), value, kind in reversed(list(zip(order, bound, kinds))):
        x = F.col(name)
        if value is None:
            reached = x.isNull() & reached
            continue
        y = F.lit(value).cast(kind)
        behind = x < y if way == "desc" else x > y
        reached = F.coalesce(behind | ((x == y) & reached), F.lit(True))  # a NULL comes last
    return reached


def with_range(df: DataFrame, order: Order, bounds: list[Row]) -> DataFrame:
    """Adds ``_range``, the number of boundaries at or before the row, by a tree of comparisons.

    All rows of a range come before those of the next, so a frame is ordered by its ranges
    and inside them; the column is an expression over the row and survives lost tasks.
    """
    kinds = [df.schema[c].dataType for c, _ in order]

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(_reached(bounds[middle], order, kinds), tree(middle + 1, high)).otherwise(tree(low, middle))

    return df.withColumn("_range", tree(0, len(bounds)))


def range_counts(ranged: DataFrame) -> dict[int, int]:
    """Rows of every range: at most one entry per shuffle partition."""
    return {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}


def number_rows(df: DataFrame, order: Order, out: str = "row_no") -> DataFrame:
    """Dense 1..n over the whole frame without a single-task window; the order must be total."""
    ranged = with_range(df, order, boundaries(df, order))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order_by(order))
    return ranged.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(starts), "_range").select(
        *df.columns, (F.col("_start") + F.col("_at")).alias(out))


def rows_between(df: DataFrame, order: Order, skip: int, n: int) -> DataFrame:
    """Rows skip + 1 .. skip + n of the order: only ranges that hold some of them are sorted."""
    bounds = boundaries(df, order)
    ranged = with_range(df, order, bounds)
    first, before, seen = None, 0, 0
    last = -1
    for number, size in sorted(range_counts(ranged).items()):
        if seen + size > skip and seen < skip + n:
            if first is None:
                first, before = number, seen
            last = number
        seen += size
    if first is None:
        return df.limit(0)
    held = ranged.filter(F.col("_range").between(first, last)).drop("_range")
    return held.orderBy(*order_by(order)).offset(skip - before).limit(n)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_{k}"])
    return on


def _cut_groups(df: DataFrame, bounds: list[Row], keys: list[str]) -> DataFrame:
    """Rows of the groups that a boundary may cut; the others lie in one range each."""
    cut = list(dict.fromkeys(tuple(b[k] for k in keys) for b in bounds))  # at most one per boundary
    if len(keys) == 1:  # a filter, which reaches the scans below
        names = [v for (v,) in cut if v is not None]
        held = F.col(keys[0]).isin(names)
        return df.filter(held | F.col(keys[0]).isNull() if len(names) < len(cut) else held)
    schema = T.StructType([T.StructField(f"_{k}", df.schema[k].dataType) for k in keys])
    held = F.broadcast(df.sparkSession.createDataFrame(cut, schema))
    return df.join(held, _same(df, held, keys), "left_semi")


def _with_starts(ranged: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Joins what a piece (range, group) starts with; at most two pieces per boundary are cut."""
    side = F.broadcast(starts.withColumnsRenamed({k: f"_{k}" for k in ["_range", *keys]}))
    return ranged.join(side, _same(ranged, side, ["_range", *keys]), "left").drop(*[f"_{k}" for k in ["_range", *keys]])


def number_in_groups(df: DataFrame, keys: list[str], order: Order, out: str = "row_no") -> DataFrame:
    """Dense 1..n inside each group. A group of any size is cut at the range boundaries and
    numbered piece by piece; each piece starts behind the rows of the pieces before it."""
    full = [*[(k, "asc") for k in keys], *order]
    bounds = boundaries(df, full)
    ranged = with_range(df, full, bounds)
    sizes = _cut_groups(ranged, bounds, keys).groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", *keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range", *keys).orderBy(*order_by(order))
    # rows may come partitioned by the key alone, which would hold a group together
    numbered = ranged.repartition("_range", *keys).withColumn("_at", F.row_number().over(inside))
    return _with_starts(numbered, starts, keys).select(
        *df.columns, (F.coalesce("_start", F.lit(0)) + F.col("_at")).cast("bigint").alias(out))


class Cuts(NamedTuple):
    """Groups of more than one piece: their keys and a frame of them with ``_at``, where they are cut."""
    keys: list[tuple]
    frame: DataFrame


def cut_groups(df: DataFrame, keys: list[str], order: Order) -> Cuts | None:
    """Groups that hold two boundaries or more, None if there are none; they are cut at these.

    A group without holds about two ranges of the rows at most and stays whole.
    """
    held: dict[tuple, list] = {}
    for bound in boundaries(df, [*[(k, "asc") for k in keys], *order]):
        held.setdefault(tuple(bound[k] for k in keys), []).append(tuple(bound[c] for c, _ in order))
    held = {k: at for k, at in held.items() if len(at) > 1}
    if not held:
        return None
    place = T.StructType([T.StructField(c, df.schema[c].dataType) for c, _ in order])
    schema = T.StructType([*[T.StructField(f"_{k}", df.schema[k].dataType) for k in keys],
                           T.StructField("_at", T.ArrayType(place))])
    return Cuts(list(held), df.sparkSession.createDataFrame([(*k, at) for k, at in held.items()], schema))


def piece_keys(keys: list[str], cuts: Cuts | None) -> list[str]:
    return keys if cuts is None else [*keys, "_range"]


def with_pieces(df: DataFrame, keys: list[str], order: Order, cuts: Cuts | None) -> DataFrame:
    """Deals the pieces of groups out. If groups are cut, ``_range`` is added, the number of the piece
    a row lies in: one look-up a row, and only rows of cut groups are compared with boundaries."""
    if cuts is None:
        return df.repartition(*keys)

    def reached(place: Column) -> Column:
        found = F.lit(True)
        for name, way in reversed(order):
            x, y = F.col(name), place[name]
            behind = x < y if way == "desc" else x > y
            found = F.when(y.isNull(), x.isNull() & found).otherwise(
                F.coalesce(behind | ((x == y) & found), F.lit(True)))  # a NULL comes last
        return found

    side = F.broadcast(cuts.frame)
    number = F.when(F.col("_at").isNull(), 0).otherwise(F.size(F.filter("_at", reached)))
    # rows may come partitioned by the key alone, which would hold a group together
    return df.join(side, _same(df, side, keys), "left").withColumn("_range", number).drop(
        "_at", *[f"_{k}" for k in keys]).repartition(*piece_keys(keys, cuts))


def for_pieces(side: DataFrame, keys: list[str], cuts: Cuts | None) -> DataFrame:
    """What is joined to pieces (by ``piece_keys``): rows of a cut group once for each piece."""
    if cuts is None:
        return side
    cut = F.broadcast(cuts.frame)
    pieces = F.sequence(F.lit(0), F.coalesce(F.size("_at"), F.lit(0)))  # at most one per boundary
    return side.join(cut, _same(side, cut, keys), "left").withColumn("_range", F.explode(pieces)).drop(
        "_at", *[f"_{k}" for k in keys])


def _of_groups(df: DataFrame, keys: list[str], cuts: Cuts) -> DataFrame:
    """Rows of the cut groups."""
    if len(keys) == 1:  # a filter, which reaches the scans below
        names = [v for (v,) in cuts.keys if v is not None]
        held = F.col(keys[0]).isin(names)
        return df.filter(held | F.col(keys[0]).isNull() if len(names) < len(cuts.keys) else held)
    held = F.broadcast(cuts.frame)
    return df.join(held, _same(df, held, keys), "left_semi")


def running_before(
    df: DataFrame, keys: list[str], order: Order, value: Column, opens: Column, initial: Column, out: str,
) -> DataFrame:
    """Adds the greatest ``value`` among the rows before this one in its group, counted from the
    last of them that ``opens`` a segment (itself included), or from ``initial`` before the first.

    NULL values do not count. A group that holds more than a range is cut at the boundaries:
    windows run over pieces, and each takes over the state with which the ones before it end.
    """
    cuts = cut_groups(df, keys, order)
    return running_in_pieces(with_pieces(df, keys, order, cuts), keys, order, value, opens, initial, out, cuts)


def running_in_pieces(
    dealt: DataFrame, keys: list[str], order: Order, value: Column, opens: Column, initial: Column, out: str,
    cuts: Cuts | None,
) -> DataFrame:
    """``running_before`` of a frame that ``with_pieces`` has dealt out; ``_range`` leaves it."""
    columns = [c for c in dealt.columns if c != "_range"]
    marked = dealt.withColumns(
        {"_value": value, "_opens": F.coalesce(opens, F.lit(False)).cast("int"), "_initial": initial})
    earlier = Window.partitionBy(*piece_keys(keys, cuts)).orderBy(*order_by(order)).rowsBetween(Window.unboundedPreceding, -1)
    # segments are numbered in order, so the greatest (segment, value) is that of the last one
    past = F.coalesce(F.sum("_opens").over(earlier), F.lit(0))
    pieces = marked.withColumn("_past", past).withColumn("_segment", F.col("_past") + F.col("_opens")).withColumn(
        "_before", F.max(F.struct("_segment", "_value")).over(earlier)["_value"])
    if cuts is None:
        first = F.greatest("_initial", "_before")
        return pieces.select(*columns, F.when(F.col("_past") == 0, first).otherwise(F.col("_before")).alias(out))

    ends = _of_groups(pieces, keys, cuts).groupBy("_range", *keys).agg(
        F.max("_segment").alias("_opened"), F.max(F.struct("_segment", "_value")).alias("_end"))
    # the end state of a piece is the greatest value of its last segment
    order_of_pieces = Window.partitionBy(*keys).orderBy("_range")
    counted = order_of_pieces.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    era = F.sum((F.col("_opened") > 0).cast("int")).over(counted)
    in_era = Window.partitionBy(*keys, "_era").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = ends.withColumn("_era", era).withColumn("_state", F.max(F.col("_end")["_value"]).over(in_era)).select(
        "_range", *keys, F.lag("_state").over(order_of_pieces).alias("_carry"),
        F.coalesce(F.lag("_era").over(order_of_pieces), F.lit(0)).alias("_carry_era"))
    joined = _with_starts(pieces, states, keys)
    # nothing has opened yet in this piece: what the pieces before it end with counts as well
    none_here = F.col("_past") == 0
    carried = F.when(F.coalesce("_carry_era", F.lit(0)) == 0, F.greatest("_carry", "_initial")).otherwise(F.col("_carry"))
    state = F.when(none_here, F.greatest(F.coalesce(carried, F.col("_initial")), F.col("_before"))).otherwise(F.col("_before"))
    return joined.select(*columns, state.alias(out))
