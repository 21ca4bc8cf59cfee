"""Windows that open at a key's first event: label events as allowed or denied.

A window opens at the first event after the previous one has ended, lasts ``seconds``
(an event exactly at its end is still inside) and allows ``limit`` events; denied events
do not extend it. Each window start depends on the one before, so an ordinary key is
walked in one pass of a grouped function, while a hot key is never gathered: its window
starts are found by pointer doubling over its distinct event times.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cargoframe.operators.skew import HOT_ROWS, durable, running_before, split_hot

CELLS_PER_WINDOW = 64


def micros(events: DataFrame, name: str) -> Column:
    """Microseconds since 1970 on the clock of the column; a time without zone has no clock shifts."""
    if isinstance(events.schema[name].dataType, T.TimestampNTZType):
        start = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", start, F.col(name))
    return F.unix_micros(F.col(name).cast("timestamp"))


def _walk(times: np.ndarray, limit: int, length: int) -> np.ndarray:
    """Allowed flags of time-ordered microseconds of one key."""
    allowed = np.zeros(len(times), dtype=bool)
    at = 0
    while at < len(times):
        end = int(np.searchsorted(times, times[at] + length, side="right"))
        allowed[at:min(at + limit, end)] = True
        at = end
    return allowed


def _cold(events: DataFrame, limit: int, length: int) -> DataFrame:
    schema = events.withColumn("allowed", F.lit(True)).schema

    def label(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_us", "id"])
        return group.assign(allowed=_walk(group["_us"].to_numpy(), limit, length))

    return events.groupBy("key").applyInPandas(label, schema)


def _successors(times: DataFrame, length: int) -> DataFrame:
    """(key, us, next): first event time later than us + length, NULL if there is none."""
    cell = max(1, length // CELLS_PER_WINDOW)
    events = times.select("key", F.col("us").alias("t"), F.col("us").alias("event"))
    asks = times.select("key", (F.col("us") + length).alias("t"), F.lit(None).cast("bigint").alias("event"))
    both = events.unionByName(asks).withColumn("cell", F.floor(F.col("t") / cell))
    later = Window.partitionBy("key", "cell").orderBy(
        F.desc("t"), F.asc_nulls_first("event")
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_in", F.min("event").over(later)).filter("event IS NULL")
    firsts = both.groupBy("key", "cell").agg(F.min("event").alias("_first"))
    # from the last cell backwards: the first event of the next cell that holds one
    following = running_before(
        firsts, ["key"], [("cell", "desc")], F.col("_first"), F.col("_first").isNotNull(),
        F.lit(None).cast("bigint"), "_beyond").select("key", "cell", "_beyond")
    return inside.join(following, ["key", "cell"]).select(
        "key", (F.col("t") - length).alias("us"), F.coalesce("_in", "_beyond").alias("next")
    )


def window_starts(times: DataFrame, length: int) -> DataFrame:
    """(key, us) of every window start among distinct event times (key, us)."""
    jump = durable(_successors(times, length))
    reached = durable(times.groupBy("key").agg(F.min("us").alias("us")))
    spans = times.groupBy("key").agg((F.max("us") - F.min("us")).alias("span"))
    longest = spans.agg(F.max("span")).first()[0] or 0
    rounds = math.ceil(math.log2(longest // length + 2))
    for step in range(rounds):
        landed = reached.join(jump, ["key", "us"]).filter("next IS NOT NULL")
        reached = durable(reached.unionByName(landed.select("key", F.col("next").alias("us"))))
        if step + 1 < rounds:
            onward = jump.select("key", F.col("us").alias("next"), F.col("next").alias("_after"))
            jump = durable(
                jump.filter("next IS NOT NULL").join(onward, ["key", "next"])
                .select("key", "us", F.col("_after").alias("next"))
            )
    return reached


def _hot(events: DataFrame, limit: int, length: int) -> DataFrame:
    starts = window_starts(events.select("key", F.col("_us").alias("us")).distinct(), length)
    # starts lie more than one length apart, so a cell of that length holds at most one
    cell = F.floor(F.col("_us") / length)
    own = starts.select("key", F.floor(F.col("us") / length).alias("_cell"), F.col("us").alias("_own"))
    before = own.select("key", (F.col("_cell") + 1).alias("_cell"), F.col("_own").alias("_before"))
    placed = (
        events.withColumn("_cell", cell)
        .join(own, ["key", "_cell"], "left")
        .join(before, ["key", "_cell"], "left")
        .withColumn(
            "_start", F.when(F.col("_own") <= F.col("_us"), F.col("_own")).otherwise(F.col("_before"))
        )
    )
    rank = Window.partitionBy("key", "_start").orderBy("_us", "id")
    passed = (
        placed.select("key", "_start", "_us", "id")
        .withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= limit)
        .select("id", F.lit(True).alias("_allowed"))
    )
    return (
        events.join(passed, "id", "left")
        .withColumn("allowed", F.col("_allowed").isNotNull())
        .drop("_allowed")
    )


def rate_limit_labels(
    events: DataFrame, limit: int, seconds: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Events (id, key, at) with ``allowed``; ids are unique, keys set, ties in time go by id."""
    length = seconds * 1_000_000
    timed = events.select("id", "key", "at", micros(events, "at").alias("_us"))
    cold, hot = split_hot(timed, ["key"], hot_rows)
    labelled = _cold(cold.select("id", "key", "at", "_us"), limit, length)
    if not hot.isEmpty():
        labelled = labelled.unionByName(
            _hot(hot, limit, length).select("id", "key", "at", "_us", "allowed")
        )
    return labelled.select("id", "key", "at", "allowed")
