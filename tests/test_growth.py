"""Steps whose shuffles and passes must not grow faster than the tables."""

import time
from datetime import datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import functions as F, types as T

from cargoframe.operators import audit, lifecycle as L, skew
from cargoframe.schema import ITEM_STATUSES
from cargoframe.sources import fixtures
from cargoframe.sources.scratch import settle
from cargoframe.streaming import feeds
from tests.conftest import same

START = datetime(2024, 1, 1)
REQUEST = ("request_id string, item_id string, new_status string, role string, actor string, "
           "requested_at timestamp_ntz, notes string")
ITEM = "id string, item_ref string, container_id bigint, status string, is_missing boolean"


def _plan(spark, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _items(spark, ids):
    return spark.createDataFrame([(i, i, 1, ITEM_STATUSES[0], False) for i in ids], ITEM)


def test_requests_and_items_are_shuffled_once(spark):
    ids = [f"i{n}" for n in range(300)]
    asked = spark.createDataFrame(
        [(f"r{i}", i, ITEM_STATUSES[1], "super_admin", "desk", START, None) for i in ids], REQUEST)
    text = _plan(spark, lambda: L.judge_item_status(_items(spark, ids), asked).select("request_id", "reason"))
    assert text.count("Exchange hashpartitioning") == 2 and text.count("Window [") == 2


def test_hot_and_null_items_are_cut_and_judged_in_turn(spark):
    """An item with a third of the requests and a third without an item lie in several pieces."""
    rows = []
    for n in range(900):
        item = ["hot", None, f"i{n % 40}"][n % 3]
        role = "super_admin" if n % 17 == 0 else "warehouse_staff"
        status = "odd" if n % 23 == 0 else ITEM_STATUSES[(n * 7) % 6]
        rows.append((f"r{n:04}", item, status, role, "desk", START + timedelta(minutes=(n * 31) % 900), None))
    asked = spark.createDataFrame(rows, REQUEST)
    cuts = skew.cut_groups(asked, ["item_id"], L.IN_TURN)
    assert {("hot",), (None,)} <= set(cuts.keys)
    now, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        status = now.get(r[1], ITEM_STATUSES[0])
        if r[1] is None:
            want[r[0]] = (None, "unknown item")
        elif r[2] == "odd":
            want[r[0]] = (status, "unknown status")
        elif r[3] == "warehouse_staff" and ITEM_STATUSES.index(r[2]) < ITEM_STATUSES.index(status):
            want[r[0]] = (status, "status can only move forward")
        else:
            want[r[0]] = (status, None)
            now[r[1]] = r[2]
    items = _items(spark, ["hot", *[f"i{n}" for n in range(40)]])
    judged = L.judge_item_status(items, asked).select("request_id", "new_status", "previous_status", "reason").collect()
    assert {r[0]: (r[2], r[3]) for r in judged} == want
    assert {r[0]: r[1] for r in judged} == {r[0]: r[2] for r in rows}


def test_deleting_reads_the_items_once(spark):
    items = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, order_id int")
    orders = spark.createDataFrame([(5,), (6,)], "id int")
    gone = orders.filter("id = 5").unionByName(spark.sql("SELECT 5 AS id UNION ALL SELECT CAST(NULL AS int)"))

    def cut():
        return L.delete_cascade({"orders": orders, "items": items}, "order", gone)["items"]

    assert sorted(map(tuple, cut().collect())) == [(1, None), (2, 6), (3, None)]
    assert _plan(spark, cut).count("Join") == 1


def test_no_shuffle_carries_names_and_templates(spark):
    changes = spark.createDataFrame([("r", "i", 1, 2, ITEM_STATUSES[1])],
                                    "request_id string, id string, customer_id int, order_id int, new_status string")
    people = spark.createDataFrame([(1, "A B", "a@b", "0551234567")], "id int, name string, email string, phone string")
    orders = spark.createDataFrame([(2, "ORD-2")], "id int, order_ref string")

    def out():
        return audit.notification_outbox(changes, people, orders, audit.default_templates(spark))

    assert [r.first_name for r in out().collect()] == ["A"]
    text = _plan(spark, out)
    assert "hashpartitioning(new_status" not in text
    assert text.index("customer_id") < text.index("Exchange hashpartitioning(order_id")


def test_jobs_write_the_joined_lines_once(spark, sf):
    from __spark_entry__ import queries

    for name in ("i1_rejected_requests", "j6_invoice_lines_quoted"):
        assert "p_partkey" not in queries()[name](spark, sf)._jdf.queryExecution().toString()


def test_no_frame_is_made_for_a_record_without_alerts():
    processor = feeds.StatusAlerts(T.StringType())
    state = SimpleNamespace(get=lambda: None, exists=lambda: False, update=lambda v: None)
    processor.kept = state
    processor.waiting = SimpleNamespace(get=lambda: iter([(5, "e", "Sorting")]), clear=lambda: None)
    timer = SimpleNamespace(getCurrentWatermarkInMs=lambda: 1)
    assert list(processor.handleExpiredTimer(("k",), timer, None)) == []


def test_shuffles_leave_the_disks_once_a_frame_is_kept(spark):
    def held():
        return len(list(Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
                             .localDirs()[0].getPath()).rglob("shuffle_*.data")))

    settle(spark.range(0), "none", lean=True)
    before = held()
    grouped = spark.range(2000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = settle(grouped, "groups", lean=True)
    deadline = time.time() + 20
    while held() > before and time.time() < deadline:
        time.sleep(0.2)
    assert held() <= before and same(kept, grouped)


def test_quoted_lines_move_once(spark, sf):
    """Only closing lines and sums of the other lines are joined again, once the lines are priced."""
    from __spark_entry__ import queries

    text = _plan(spark, lambda: queries()["j6_invoice_lines_quoted"](spark, sf))
    assert text.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2


def test_stored_lines_hold_what_the_items_need(spark, sf):
    wanted = ["id", "order_id", "status", "quantity"]
    items = fixtures.stored_items(spark, sf, *wanted)
    held = set(spark.read.parquet(items.inputFiles()[0]).columns)
    assert "l_linestatus" in held and not held & {"p_size", "p_name", "o_custkey", "l_tax", "l_shipdate"}
    assert same(items, fixtures.items(spark, sf).select(*wanted))


def test_ended_items_are_those_moved(spark):
    """Also for an id that is repeated, with a container once, and for items without an accepted request."""
    items = spark.createDataFrame(
        [("a", "a", 1, ITEM_STATUSES[0], True), ("b", "b", None, ITEM_STATUSES[2], True), ("b", "b", 2, ITEM_STATUSES[2], None),
         ("c", "c", 1, ITEM_STATUSES[4], False), ("d", "d", 1, ITEM_STATUSES[0], True)], ITEM)
    asked = spark.createDataFrame(
        [("r1", "a", ITEM_STATUSES[1], "super_admin", "x", START, None), ("r2", "a", ITEM_STATUSES[3], "super_admin", "x", START, None),
         ("r3", "b", ITEM_STATUSES[1], "super_admin", "x", START, None), ("r4", "c", ITEM_STATUSES[1], "warehouse_staff", "x", START, None),
         ("r5", None, ITEM_STATUSES[1], "super_admin", "x", START, None), ("r6", "d", ITEM_STATUSES[1], "super_admin", "x", START, None)], REQUEST)
    judged = L.judge_item_status(items, asked)
    moved = L.moved_items(items, judged).groupBy("id").agg(F.max(F.struct("status", "is_missing")).alias("s"))
    want = sorted((r.id, r.s.status, r.s.is_missing) for r in moved.collect())
    assert sorted(map(tuple, L.ended_items(judged).collect())) == want
    assert [w[0] for w in want] == ["a", "b", "d"]


def test_a_transition_batch_is_not_cached(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    asked = spark.createDataFrame([("r", "i1", ITEM_STATUSES[1], "super_admin", "desk", START, None)], REQUEST)
    asked.write.parquet(f"{tmp_path}/in")
    store = feeds.item_store(_items(spark, ["i1", "i2"]), f"{tmp_path}/items")
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: (_ for _ in ()).throw(AssertionError("cached")))
    feeds.transition_stream(spark.readStream.schema(asked.schema).parquet(f"{tmp_path}/in"), store.root,
                            f"{tmp_path}/history", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted((r.id, r.status) for r in store.rows().collect()) == [("i1", ITEM_STATUSES[1]), ("i2", ITEM_STATUSES[0])]
