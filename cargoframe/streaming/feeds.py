"""Status alerts, rate limits, transitions and payments as batch jobs and as streams.

A stream equals its batch form on the same input in event order. Changes go to a keyed store
(``store``), which reads only the buckets that a micro-batch names and applies each batch once.
"""

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql import types as T

from cargoframe.operators.lifecycle import (
    apply_judged_status, ended_items, judge_item_status, sync_payment_status,
)
from cargoframe.operators.skew import HOT_ROWS, join_unique
from cargoframe.operators.throttle import micros
from cargoframe.sources.scratch import remove, settle
from cargoframe.streaming.store import KeyedStore

LATENESS_DAYS = 1
LATENESS = f"{LATENESS_DAYS} day"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enable_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def status_changes(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First alert per (record, status): the record changed to it from another status.

    A status other than the record's first one is news when it first occurs; the first
    status is news when it first comes back. Only aggregates per record are formed.
    """
    place = F.struct("changed_at", "id")
    seen = events.groupBy("record_id", "new_status").agg(F.min(place).alias("at"))
    firsts = seen.groupBy("record_id").agg(F.min(F.struct("at", "new_status")).alias("_base"))
    base = firsts.select(
        "record_id", F.col("_base.new_status").alias("_first"), F.col("_base.at").alias("_at0")
    )
    tagged = seen.join(base, "record_id")
    fresh = tagged.filter(F.col("new_status") != F.col("_first"))
    left = fresh.groupBy("record_id", "_first").agg(F.min("at").alias("_left"))
    rows = events.select("record_id", "new_status", place.alias("at"))
    back = (
        join_unique(rows, left, ["record_id"], "inner", hot_rows)
        .filter((F.col("new_status") == F.col("_first")) & (F.col("at") > F.col("_left")))
        .groupBy("record_id", "new_status").agg(F.min("at").alias("at"))
    )
    alerts = fresh.select("record_id", "new_status", "at").unionByName(back)
    return alerts.select(
        "record_id", "new_status", F.col("at.changed_at").alias("changed_at"),
        F.col("at.id").alias("event_id"),
    )


def newest_alerts(alerts: DataFrame, n: int = 25) -> DataFrame:
    return alerts.orderBy(F.desc("changed_at"), F.desc("event_id")).limit(n)


def alert_schema(events: DataFrame) -> T.StructType:
    """Alerts and late rows of a stream whose ids may have any type; ``late`` marks the latter."""
    return T.StructType([
        T.StructField("record_id", events.schema["record_id"].dataType),
        T.StructField("new_status", T.StringType()),
        T.StructField("changed_at", T.TimestampType()),
        T.StructField("event_id", events.schema["id"].dataType),
        T.StructField("late", T.BooleanType()),
    ])


class StatusAlerts(StatefulProcessor):
    """Status events of one record in event order.

    Events wait in state until the watermark, one day behind the newest event, has passed
    them; a timer then takes them in order. Events behind the watermark are late: they are given
    back as such and change nothing. Input is read chunk by chunk, and what waits is at most
    the events of the record in the last day. The last status and the announced ones
    are one value; there are as many announced statuses as life-cycle steps at most.
    """

    def __init__(self, id_type: T.DataType):
        self.id_type = id_type

    def init(self, handle):
        self.handle = handle
        kept = T.StructType(
            [T.StructField("last", T.StringType()), T.StructField("seen", T.StringType())]
        )
        self.kept = handle.getValueState("kept", kept)
        event = T.StructType([T.StructField("us", T.LongType()), T.StructField("id", self.id_type),
                              T.StructField("status", T.StringType())])
        self.waiting = handle.getListState("waiting", event)

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = earliest = None
        for chunk in rows:
            # plain lists: a frame operation on the few rows of a record costs more than the rows
            us = chunk["changed_at"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            late, events = [], []
            for u, i, s in zip(us, chunk["id"].tolist(), chunk["new_status"].tolist()):
                if u < passed:
                    late.append((s, u, i, True))
                else:
                    events.append((u, i, s))
            if late:
                yield self._out(key, late)
            if events:
                if waiting is None:
                    waiting = self.waiting.exists()
                self.waiting.appendList(events)
                first = min(e[0] for e in events)
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            due = earliest // 1000 + 1
            timers = sorted(self.handle.listTimers()) if waiting else []
            if not timers or due < timers[0]:
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(e) for e in self.waiting.get())
        ready, rest = [e for e in held if e[0] < passed], [e for e in held if e[0] >= passed]
        last, seen = self.kept.get() or (None, "[]")
        seen, out = json.loads(seen), []
        for us, event, status in ready:
            if last is not None and status != last and status not in seen:
                seen.append(status)
                out.append((status, us, event, False))
            last = status
        if ready:
            self.kept.update((last, json.dumps(seen)))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if out:
            yield self._out(key, out)

    def _out(self, key, found):
        # plain objects: Arrow-backed text columns come as chunks, which state output refuses
        status, us, event, late = zip(*found)
        return pd.DataFrame({
            "record_id": pd.Series([key[0]] * len(found), dtype=object), "new_status": pd.Series(status, dtype=object),
            "changed_at": np.array(us, dtype="int64").view("datetime64[us]"),
            "event_id": pd.Series(event, dtype=object), "late": pd.Series(late, dtype=object)})

    def close(self):
        pass


def status_change_feed(events: DataFrame) -> DataFrame:
    """Streaming form of ``status_changes`` over (id, record_id, new_status, changed_at), ids of any type.

    An alert comes out once the watermark has passed its event; rows behind the watermark come
    out with ``late`` set, so that they can be counted. Bound the input of a trigger at the
    source (``maxFilesPerTrigger``).
    """
    enable_state(events.sparkSession)
    marked = events.select(
        "record_id", "new_status", F.col("changed_at").cast("timestamp").alias("changed_at"), "id"
    ).withWatermark("changed_at", LATENESS)
    # a copy of the time without the mark: Spark would drop late rows itself, uncounted after a restart
    timely = marked.withColumn("changed_at", F.timestamp_micros(F.unix_micros("changed_at")))
    return timely.groupBy("record_id").transformWithStateInPandas(
        StatusAlerts(events.schema["id"].dataType), alert_schema(events), "Append", "EventTime")


def label_schema(events: DataFrame) -> T.StructType:
    kinds = {c: events.schema[c].dataType for c in ("id", "key")}
    return T.StructType([
        T.StructField("id", kinds["id"]), T.StructField("key", kinds["key"]),
        T.StructField("us", T.LongType()), T.StructField("allowed", T.BooleanType()),
    ])


class RateLimit(StatefulProcessor):
    """Keeps the end of the open window of one key and the events it has taken.

    Of a micro-batch only the times and ids of a key are held, to bring them in order; the
    source bounds how many there are.
    """

    def __init__(self, limit: int, seconds: int):
        self.limit = limit
        self.length = seconds * 1_000_000

    def init(self, handle):
        self.handle = handle
        pair = T.StructType(
            [T.StructField("ends", T.LongType()), T.StructField("taken", T.LongType())]
        )
        self.open = handle.getValueState("open", pair)

    def handleInputRows(self, key, rows, timerValues):
        events = sorted((us, i) for chunk in rows for us, i in zip(chunk["us"].tolist(), chunk["id"].tolist()))
        ends, taken = self.open.get() if self.open.exists() else (None, 0)
        for low in range(0, len(events), 10_000):
            part, allowed = events[low:low + 10_000], []
            for us, _ in part:
                if ends is None or us > ends:
                    ends, taken = us + self.length, 0
                allowed.append(taken < self.limit)
                taken += allowed[-1]
            yield pd.DataFrame({
                "id": pd.Series([i for _, i in part], dtype=object), "key": pd.Series([key[0]] * len(part), dtype=object),
                "us": [us for us, _ in part], "allowed": allowed})
        self.open.update((int(ends), int(taken)))

    def close(self):
        pass


def rate_limit_feed(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Streaming form of ``rate_limit_labels`` over (id, key, at), ids and keys of any type: id, key,
    us (microseconds of ``at``) and allowed. Bound the input of a trigger at the source."""
    enable_state(events.sparkSession)
    rows = events.select("id", "key", micros(events, "at").alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(
        RateLimit(limit, seconds), label_schema(events), "Append", "None"
    )


# Changes of the item and order tables -------------------------------------------------

ITEM_CHANGES = ["status", "is_missing"]
ORDER_CHANGES = ["status", "snapshot_at"]


def item_store(items: DataFrame, root: str, **options) -> KeyedStore:
    return KeyedStore.create(items, root, ITEM_CHANGES, **options)


def order_store(orders: DataFrame, root: str, **options) -> KeyedStore:
    """Orders bucketed by sale, with the time of the snapshot that was applied last."""
    timed = orders.withColumn("snapshot_at", F.lit(None).cast("timestamp"))
    return KeyedStore.create(timed, root, ORDER_CHANGES, key="sale_id", **options)


def _small(rows: DataFrame):
    return rows.write.mode("overwrite").option("compression", "zstd")


def _folder(root: str, batch: int) -> str:
    return f"{root}/batch={batch}"


def transition_stream(
    requests: DataFrame, store_root: str, history_root: str, checkpoint: str,
    rejected_root: str | None = None,
) -> StreamingQuery:
    """Apply a stream of item status requests to an item store; history is appended per batch.

    Requests take effect in turn inside a micro-batch and from batch to batch, so requests that
    arrive in order give what ``apply_item_status`` gives on all of them.
    """
    def apply(batch: DataFrame, number: int):
        store = KeyedStore(batch.sparkSession, store_root)
        version, state = store.state()
        if store.is_done(state, checkpoint, number):
            return
        now = store.rows(state, store.buckets_of(batch.select(F.col("item_id").alias("id")))).select(
            "id", "item_ref", "container_id", "status", "is_missing")  # what history and store take
        # written once instead of cached: a cache takes the memory of the sorts, which then spill, and more disk
        judged = settle(judge_item_status(now, batch), "judged", lean=True)
        change = apply_judged_status(now, judged)
        _small(change.history).parquet(_folder(history_root, number))
        if rejected_root is not None:
            _small(change.rejected).parquet(_folder(rejected_root, number))
        store.commit(version, state, ended_items(judged), checkpoint, number)
        remove(batch.sparkSession, *{f.rsplit("/", 1)[0] for f in judged.inputFiles()})

    return (
        requests.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def payment_stream(
    snapshots: DataFrame, store_root: str, late_root: str, checkpoint: str
) -> StreamingQuery:
    """Apply a stream of payment snapshots (sale_id, total_amount, sale_paid, sale_balance, at).

    Rows more than a day older than the newest row of the batches before are late: they are
    written to ``late_root`` and not applied. Of the others the newest snapshot of a sale counts,
    if it is newer than the one applied before, so repeated snapshots change nothing.
    """
    def apply(batch: DataFrame, number: int):
        store = KeyedStore(batch.sparkSession, store_root)
        version, state = store.state()
        if store.is_done(state, checkpoint, number):
            return
        batch = batch.persist()
        at = F.unix_micros("at")
        newest_before = state["kept"].get("newest")
        is_late = F.lit(False) if newest_before is None else F.coalesce(
            at < F.lit(newest_before - LATENESS_DAYS * 86_400_000_000), F.lit(False))
        batch.filter(is_late).write.mode("overwrite").parquet(_folder(late_root, number))
        timely = batch.filter(~is_late)
        values = ["total_amount", "sale_paid", "sale_balance"]
        newest = timely.groupBy("sale_id").agg(F.max(F.struct("at", *values)).alias("_s"))
        newest = newest.select("sale_id", F.col("_s.at").alias("_at"), *[f"_s.{v}" for v in values])
        now = store.rows(state, store.buckets_of(timely)).join(newest.select("sale_id", "_at"), "sale_id").filter(
            F.col("snapshot_at").isNull() | (F.col("_at") > F.col("snapshot_at")))
        table, _ = sync_payment_status(now, newest.drop("_at"))
        changed = table.withColumn("snapshot_at", F.col("_at"))
        seen = batch.agg(F.max(at)).first()[0]
        known = [t for t in (newest_before, seen) if t is not None]
        store.commit(version, state, changed, checkpoint, number, {"newest": max(known, default=None)})
        batch.unpersist()

    return (
        snapshots.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_rows(spark: SparkSession, late_root: str, schema: T.StructType) -> DataFrame:
    """All rows that came too late, over every batch and restart."""
    return spark.read.schema(schema).parquet(late_root)
