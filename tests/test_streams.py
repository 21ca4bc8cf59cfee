"""Streams equal their batch forms on the same input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargoframe.operators import lifecycle, throttle
from cargoframe.sources import fixtures as X
from cargoframe.sources.tables import Conflict
from cargoframe.streaming import feeds
from cargoframe.streaming.store import COMPACT, KeyedStore
from tests.conftest import rows, same


def write_parts(df, folder, order, parts):
    """The frame as files of consecutive rows, oldest first."""
    ordered = [tuple(r) for r in df.orderBy(*order).collect()]
    size = -(-len(ordered) // parts)
    for n in range(parts):
        piece = df.sparkSession.createDataFrame(ordered[n * size:(n + 1) * size], df.schema)
        piece.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run(df, name, checkpoint):
    query = (df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    assert query.awaitTermination(180) and query.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture()
def history(spark, sf):
    return X.raw_history(spark, sf).select("id", "record_id", "new_status", "changed_at")


def settled(history, batch):
    """Alerts of events that the last watermark has passed."""
    last = history.agg(F.max("changed_at")).first()[0]
    return batch.filter(F.col("changed_at") < F.lit(last - dt.timedelta(days=1)))


def test_status_feed(spark, history, tmp_path):
    """Text ids, files whose rows overlap by less than a day; equal to the batch form."""
    source = str(tmp_path / "in")
    text = history.withColumns({"record_id": F.concat(F.lit("r"), F.col("record_id").cast("string")),
                                "id": F.format_string("e%09d", "id")})
    jumbled = text.withColumn("o", F.col("changed_at") + F.expr("make_dt_interval(0, xxhash64(id) % 12)"))
    write_parts(jumbled, source, ["o"], 4)
    feed = feeds.status_change_feed(stream(spark, source, jumbled.schema).drop("o"))
    got = run(feed, "alerts", str(tmp_path / "cp"))
    batch = feeds.status_changes(text)
    assert got.filter("late").isEmpty()
    columns = ("record_id", "new_status", "event_id")
    want = settled(text, batch).select(*columns)
    assert want.count() > 0 and same(got.select(*columns), want)
    assert feeds.newest_alerts(batch).count() == min(25, batch.count())


def test_late_status_events_are_given_back(spark, tmp_path):
    source = str(tmp_path / "in")
    ddl = "id string, record_id string, new_status string, day string"
    files = [[("a1", "a", "x", "2024-01-01"), ("a2", "a", "y", "2024-01-03"), ("b1", "b", "x", "2024-01-09")],
             [("a3", "a", "z", "2024-01-02"), ("a4", "a", "z", "2024-01-08 12:00:00")],
             [("b2", "b", "y", "2024-02-01")], [("b3", "b", "z", "2024-01-01"), ("c1", "c", "x", "2024-03-01")]]
    for part in files:
        df = spark.createDataFrame(part, ddl).select(
            "id", "record_id", "new_status", F.col("day").cast("timestamp_ntz").alias("changed_at"))
        df.coalesce(1).write.mode("append").parquet(source)
    got = run(feeds.status_change_feed(stream(spark, source, df.schema)), "late", str(tmp_path / "cp"))
    assert rows(got.filter("late"), "event_id") == [("a3",), ("b3",)]
    assert rows(got.filter("NOT late"), "event_id", "new_status") == [("a2", "y"), ("a4", "z"), ("b2", "y")]


def test_rate_limit_feed(spark, sf, tmp_path):
    events = X.base(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("at"))
    source = str(tmp_path / "in")
    write_parts(events, source, ["at", "id"], 3)
    feed = feeds.rate_limit_feed(stream(spark, source, events.schema), 2, 86400)
    got = run(feed, "labels", str(tmp_path / "cp"))
    assert same(got.select("id", "allowed"), throttle.rate_limit_labels(events, 2, 86400).select("id", "allowed"))


def test_transition_stream_equals_one_job(spark, sf, tmp_path):
    root, source, past = str(tmp_path / "items"), str(tmp_path / "in"), str(tmp_path / "past")
    items = X.items(spark, sf)
    feeds.item_store(items, root, buckets=8)
    asked = X.status_requests(spark, sf)
    write_parts(asked, source, ["requested_at", "request_id"], 10)

    def go(checkpoint):
        query = feeds.transition_stream(
            stream(spark, source, asked.schema), root, past, str(tmp_path / checkpoint), str(tmp_path / "no"))
        query.awaitTermination(600)
        assert query.exception() is None

    go("cp")
    kept = KeyedStore(spark, root)
    change = lifecycle.apply_item_status(items, asked)
    columns = ("id", "status", "is_missing")
    assert same(kept.rows().select(*columns), change.table.select(*columns))
    assert spark.read.parquet(past).count() == change.history.count()
    assert spark.read.parquet(str(tmp_path / "no")).count() == change.rejected.count()
    version, state = kept.state()
    assert version == 10 and len(state["deltas"]) < COMPACT  # compacted on the way
    go("cp")  # nothing new: nothing is applied twice
    assert kept.state()[0] == version


def test_store_reads_do_not_grow(spark, tmp_path):
    root = str(tmp_path / "s")
    table = spark.range(1000).select("id", F.lit(0).alias("v"), F.lit("x").alias("w"))
    kept, read = KeyedStore.create(table, root, ["v"], buckets=4), []
    expected = {n: 0 for n in range(1000)}
    for batch in range(20):
        version, state = kept.state()
        ids = spark.range(batch, batch + 30, 7).select("id")
        held = kept.files(state, kept.buckets_of(ids))
        read.append(len(held[0]) + len(held[1]))
        now = kept.rows(state, kept.buckets_of(ids)).join(ids, "id")
        kept.commit(version, state, now.withColumn("v", F.col("v") + 1), "w", batch)
        for n in range(batch, batch + 30, 7):
            expected[n] += 1
    assert {r["id"]: r["v"] for r in kept.rows().collect()} == expected
    assert max(read) <= 4 * (1 + COMPACT)
    version, state = kept.state()
    assert kept.is_done(state, "w", 19) and not kept.is_done(state, "w", 20) and not kept.is_done(state, "v", 0)
    with pytest.raises(Conflict):
        kept.commit(version - 1, state, table.limit(1), "other", 0)
    assert kept.state()[0] == version


def test_payment_stream(spark, sf, tmp_path):
    root, source, late = (str(tmp_path / n) for n in ("orders", "in", "late"))
    orders = X.sold_orders(spark, sf)
    kept = feeds.order_store(orders, root, buckets=8)
    parsed = lifecycle.parse_snapshots(X.snapshot_payloads(spark, sf))
    snapshots = parsed.withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    write_parts(snapshots.unionByName(snapshots), source, ["sale_id"], 2)
    query = feeds.payment_stream(stream(spark, source, snapshots.schema), root, late, str(tmp_path / "cp"))
    query.awaitTermination(300)
    assert query.exception() is None
    expected, _ = lifecycle.sync_payment_status(orders, parsed)
    assert same(kept.rows().select("id", "status"), expected.select("id", "status"))
    assert feeds.late_rows(spark, late, snapshots.schema).isEmpty()


def test_late_snapshots_are_kept_over_restarts(spark, tmp_path):
    root, source, late = (str(tmp_path / n) for n in ("orders", "in", "late"))
    orders = spark.createDataFrame([(f"o{n}", f"S{n}", "Pending") for n in range(4)], "id string, sale_id string, status string")
    kept = feeds.order_store(orders, root, buckets=2)
    ddl = "sale_id string, total_amount double, sale_paid double, sale_balance double, day string"

    def go(*new):
        for day, sale, paid in new:
            row = spark.createDataFrame([(sale, 5.0, paid, 5.0 - paid, day)], ddl).select(
                *ddl.replace(" string", "").replace(" double", "").split(", ")[:4], F.col("day").cast("timestamp").alias("at"))
            row.coalesce(1).write.mode("append").parquet(source)
        query = feeds.payment_stream(stream(spark, source, row.schema), root, late, str(tmp_path / "cp"))
        query.awaitTermination(300)
        assert query.exception() is None
        return rows(feeds.late_rows(spark, late, row.schema), "sale_id")

    assert go(("2024-01-10", "S0", 5.0), ("2024-01-11", "S1", 2.0), ("2024-01-01", "S2", 5.0)) == [("S2",)]
    # after a restart: an older snapshot within the day changes nothing, an old one is late
    assert go(("2024-01-10 12:00:00", "S1", 5.0), ("2024-01-05", "S3", 5.0)) == [("S2",), ("S3",)]
    assert rows(kept.rows(), "id", "status") == [("o0", "Paid"), ("o1", "Partial"), ("o2", "Pending"), ("o3", "Pending")]
