"""Lifecycle jobs, audit and table writes on hand-made frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cargoframe.operators import audit, lifecycle as L, windows
from cargoframe.schema import ITEM_STATUSES
from cargoframe.sources import loads, tables
from tests.conftest import rows, same

NOW = dt.datetime(2024, 5, 1)
REQUEST = ("request_id string, item_id string, new_status string, role string, actor string, "
           "requested_at timestamp_ntz, notes string")


def make_items(spark, *data):
    raw = spark.createDataFrame(list(data), "id string, status string, container_id string, is_missing boolean, order_id string")
    return loads.load_items(raw.withColumn("customer_id", F.lit("c")))


def request(n, item, status, role="super_admin", at=NOW):
    return (f"r{n}", item, status, role, "ops@example.com" if n % 2 else "desk", at, None)


def test_item_status_guards(spark):
    items = make_items(
        spark, ("a", "Sorting", "k", True, None), ("b", "Sorting", "k", True, None),
        ("c", ITEM_STATUSES[0], None, False, None), ("d", ITEM_STATUSES[0], "k", False, None),
        ("e", "Sorting", "k", True, None))
    asked = spark.createDataFrame([
        request(1, "a", "Ready for Pickup"), request(2, "b", ITEM_STATUSES[0], "warehouse_staff"),
        request(3, "c", "Shipped to Ghana"), request(4, "d", "Shipped to Ghana", "warehouse_staff"),
        request(5, "e", ITEM_STATUSES[0]), request(6, "nope", "Sorting"),
        request(7, "a", "Completed", at=NOW - dt.timedelta(days=1))], REQUEST)
    change = L.apply_item_status(items, asked)
    assert rows(change.table, "id", "status", "is_missing") == [
        ("a", "Ready for Pickup", False), ("b", "Sorting", True), ("c", ITEM_STATUSES[0], False),
        ("d", "Shipped to Ghana", False), ("e", ITEM_STATUSES[0], True)]
    assert rows(change.rejected, "request_id", "reason") == [
        ("r2", "status can only move forward"), ("r3", "no container"), ("r6", "unknown item")]
    assert rows(change.history, "record_id", "previous_status", "changed_by") == [
        ("a", "Completed", "ops@example.com"), ("a", "Sorting", "ops@example.com"), ("d", ITEM_STATUSES[0], None),
        ("e", "Sorting", "ops@example.com")]
    log = loads.load_status_history(spark.createDataFrame([("h", "a")], "id string, record_id string"))
    assert audit.history_log(log, change.history).count() == 5


def sequential(items, requests):
    """Requests one after the other, as a plain loop: (status by item, flags, accepted, rejected)."""
    status = {i: (s, box, missing) for i, s, box, missing, _ in items}
    accepted, rejected = [], []
    for n, item, new, role, _, _, _ in sorted(requests, key=lambda r: (r[5], r[0])):
        if item not in status:
            rejected.append((n, "unknown item"))
            continue
        old, box, missing = status[item]
        if role == "warehouse_staff" and ITEM_STATUSES.index(new) < ITEM_STATUSES.index(old):
            rejected.append((n, "status can only move forward"))
        elif new == "Shipped to Ghana" and box is None:
            rejected.append((n, "no container"))
        else:
            accepted.append((n, old, new))
            status[item] = new, box, missing and new not in ITEM_STATUSES[2:]
    return status, sorted(accepted), sorted(rejected)


def test_item_status_in_turn_with_a_hot_item(spark):
    random.seed(11)
    items = [(f"i{n}", random.choice(ITEM_STATUSES), random.choice(["k", None]), True, None) for n in range(30)]
    asked = []
    for n in range(1500):
        item = "i0" if random.random() < 0.4 else f"i{random.randrange(33)}"
        role = "super_admin" if random.random() < 0.15 else random.choice(["warehouse_staff", "warehouse_staff", None])
        asked.append((f"r{n:05d}", item, random.choice(ITEM_STATUSES), role, "x", NOW + dt.timedelta(minutes=random.randrange(400)), None))
    change = L.apply_item_status(make_items(spark, *items), spark.createDataFrame(asked, REQUEST))
    status, accepted, rejected = sequential(items, asked)
    assert rows(change.table, "id", "status", "is_missing") == sorted((i, s, m) for i, (s, _, m) in status.items())
    assert rows(change.accepted, "request_id", "previous_status", "new_status") == accepted
    assert rows(change.rejected, "request_id", "reason") == rejected
    assert change.history.count() == len(accepted)


def make_containers(spark, *data):
    return loads.load_containers(spark.createDataFrame(list(data), "id string, status string, arrival_date timestamp_ntz"))


def test_cascade_is_idempotent(spark):
    boxes = make_containers(spark, ("k", "Loading", None), ("m", "Loading", NOW))
    items = make_items(spark, ("a", ITEM_STATUSES[0], "k", True, None), ("b", "Completed", "m", False, None),
                       ("c", "Completed", None, False, None))
    asked = spark.createDataFrame(
        [("1", "k", "Arrived in Ghana", NOW, NOW), ("2", "m", "Loading", None, NOW), ("3", "zz", "Loading", None, NOW)],
        "request_id string, container_id string, new_status string, arrival_date timestamp_ntz, requested_at timestamp_ntz")
    once = L.cascade_container_status(boxes, items, asked, log_history=True)
    assert rows(once.items, "id", "status", "is_missing") == [
        ("a", "Sorting", True), ("b", "Completed", False), ("c", "Completed", False)]
    assert rows(once.containers, "id", "status", "arrival_date") == [("k", "Arrived in Ghana", NOW), ("m", "Loading", NOW)]
    assert rows(once.history, "record_id", "new_status") == [("a", "Sorting")]
    twice = L.cascade_container_status(once.containers, once.items, asked)
    assert same(twice.items, once.items) and twice.history is None
    synced, counts = L.sync_container_items(once.containers, once.items)
    assert same(synced, once.items)
    assert rows(counts, "container_id", "updated") == [("k", 1), ("m", 0)]


def test_cascade_follows_every_request_in_turn(spark):
    boxes = make_containers(spark, ("k", "Loading", None))
    items = make_items(spark, ("a", ITEM_STATUSES[0], "k", True, None))
    day = dt.timedelta(days=1)
    asked = spark.createDataFrame(
        [("1", "k", "Shipped to Ghana", NOW, NOW), ("2", "k", "Loading", None, NOW + day), ("3", "zz", "Loading", None, NOW)],
        "request_id string, container_id string, new_status string, arrival_date timestamp_ntz, requested_at timestamp_ntz")
    done = L.cascade_container_status(boxes, items, asked, log_history=True)
    assert rows(done.containers, "id", "status", "arrival_date") == [("k", "Loading", NOW)]
    assert rows(done.items, "id", "status") == [("a", "Shipped to Ghana")]
    assert rows(done.history, "previous_status", "new_status") == [(ITEM_STATUSES[0], "Shipped to Ghana")]
    assert rows(done.rejected, "request_id", "reason") == [("3", "unknown container")]
    more = asked.unionByName(spark.createDataFrame([("4", "k", "Arrived in Ghana", None, NOW + 2 * day)], asked.schema))
    done = L.cascade_container_status(boxes, items, more, log_history=True)
    assert rows(done.containers, "status", "arrival_date") == [("Arrived in Ghana", NOW)]
    assert rows(done.history, "previous_status", "new_status") == [
        (ITEM_STATUSES[0], "Shipped to Ghana"), ("Shipped to Ghana", "Sorting")]


def test_loading_first_request_wins(spark):
    boxes = make_containers(spark, ("k", "Loading", None), ("m", "Loading", None))
    items = make_items(spark, ("a", "Sorting", None, False, None), ("b", "Sorting", "k", False, None))
    later = NOW + dt.timedelta(hours=1)
    asked = spark.createDataFrame(
        [("1", "a", "m", NOW), ("2", "a", "k", later), ("3", "a", "m", later), ("4", "b", "m", NOW),
         ("5", "b", "k", NOW), ("6", "x", "k", NOW), ("7", "a", "zz", NOW - dt.timedelta(1))],
        "request_id string, item_id string, container_id string, requested_at timestamp_ntz")
    for hot_rows in (1_000_000, 1):
        done = L.load_items_to_container(items, boxes, asked, hot_rows)
        assert rows(done.table, "id", "container_id") == [("a", "m"), ("b", "k")]
        assert rows(done.accepted, "request_id") == [("1",), ("3",), ("5",)]
        assert rows(done.rejected, "request_id", "reason") == [
            ("2", "in another container"), ("4", "in another container"), ("6", "unknown item"),
            ("7", "unknown container")]
    unloaded = L.unload_items(items, spark.createDataFrame([("b",), ("b",)], "item_id string"))
    assert rows(unloaded, "id", "container_id") == [("a", None), ("b", None)]


def test_sorting_actions(spark):
    items = make_items(spark, ("a", "Sorting", "k", True, None), ("b", "Sorting", "k", False, None))
    actions = spark.createDataFrame(
        [("1", "a", "found", "super_admin", "x@y.z", NOW), ("2", "b", "missing", "super_admin", "x@y.z", NOW)],
        "request_id string, item_id string, action string, role string, actor string, requested_at timestamp_ntz")
    change = L.mark_sorting(items, actions)
    assert rows(change.table, "id", "status", "is_missing") == [("a", "Ready for Pickup", False), ("b", "Sorting", True)]
    assert rows(change.history, "record_id", "notes") == [("a", "Item found during sorting")]


def test_sorting_actions_in_turn(spark):
    items = make_items(spark, ("a", "Arrived in Ghana", "k", False, None), ("b", "Sorting", "k", True, None))
    steps = [("1", "a", "missing"), ("2", "a", "found"), ("3", "a", "lost"), ("4", "a", "found"), ("5", "a", "missing"),
             ("6", "b", "missing"), ("7", "zz", "found")]
    actions = spark.createDataFrame(
        [(n, i, a, "super_admin", "x@y.z", NOW + dt.timedelta(hours=int(n))) for n, i, a in steps],
        "request_id string, item_id string, action string, role string, actor string, requested_at timestamp_ntz")
    change = L.mark_sorting(items, actions)
    assert rows(change.table, "id", "status", "is_missing") == [("a", "Ready for Pickup", True), ("b", "Sorting", True)]
    assert rows(change.accepted, "request_id", "previous_status", "new_status") == [
        ("1", "Arrived in Ghana", "Arrived in Ghana"), ("2", "Arrived in Ghana", "Ready for Pickup"),
        ("4", "Ready for Pickup", "Ready for Pickup"), ("5", "Ready for Pickup", "Ready for Pickup"), ("6", "Sorting", "Sorting")]
    assert rows(change.rejected, "request_id", "reason") == [("3", "unknown action"), ("7", "unknown item")]
    assert rows(change.history, "previous_status") == [("Arrived in Ghana",), ("Ready for Pickup",)]


def test_deletes(spark):
    items = make_items(spark, ("a", "Sorting", "k", True, "o"), ("b", "Sorting", "m", False, "p"))
    boxes = loads.load_containers(spark.createDataFrame([("k", ["a", "q"]), ("m", ["b"])], "id string, item_ids array<string>"))
    users = loads.load_users(spark.createDataFrame([("u", "c"), ("v", "d")], "id string, customer_id string"))
    people = loads.load_customers(spark.createDataFrame([("c",), ("d",)], "id string"))
    k = spark.createDataFrame([("k",)], "id string")
    gone = L.delete_cascade({"containers": boxes, "items": items}, "container", k)
    assert rows(gone["containers"], "id") == [("m",)]
    assert rows(gone["items"], "id", "container_id") == [("a", None), ("b", "m")]
    c = spark.createDataFrame([("c",)], "id string")
    gone = L.delete_cascade({"customers": people, "users": users}, "customer", c)
    assert set(gone) == {"customers", "users"} and rows(gone["users"], "id") == [("v",)]
    a = spark.createDataFrame([("a",)], "id string")
    gone = L.delete_cascade({"containers": boxes, "items": items}, "item", a)
    assert rows(gone["items"], "id") == [("b",)]
    assert rows(gone["containers"], "id", "item_ids") == [("k", ["q"]), ("m", ["b"])]


def make_orders(spark, *data):
    raw = spark.createDataFrame(list(data), "id string, status string, a double, p double, sale_id string")
    return loads.load_orders(raw.withColumn("invoice_amount", F.col("a")).withColumn("amount_paid", F.col("p")))


def test_payments_and_sync(spark):
    orders = make_orders(spark, ("a", "Pending", 100.0, None, "s1"), ("b", "Partial", 100.0, 60.0, "s2"),
                         ("c", "Pending", 100.0, None, None), ("d", "Paid", 100.0, None, "s4"))
    pays = spark.createDataFrame([("a", 30.0), ("a", 30.0), ("b", 40.0)], "order_id string, amount double")
    pays = pays.withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = rows(L.apply_payments(orders, pays), "id", "status", "amount_paid", "balance_due")
    assert [(r[0], r[1], r[2] and float(r[2]), r[3] and float(r[3])) for r in got][:2] == [
        ("a", "Partial", 60.0, 40.0), ("b", "Paid", 100.0, 0)]
    raw = spark.createDataFrame(
        [("s1", '{"total_amount": 100, "amount_paid": 0}'), ("s2", '{"balance": 0, "total_amount": 5}'), ("s4", "{}")],
        "sale_id string, payload string")
    table, counts = L.sync_payment_status(orders, L.parse_snapshots(raw))
    assert rows(table, "id", "status") == [("a", "Pending"), ("b", "Paid"), ("c", "Pending"), ("d", "Paid")]
    assert tuple(counts.first()) == (2, 1, 0)
    shown = rows(L.payment_position(orders, L.parse_snapshots(raw)), "order_id", "shown_total", "shown_paid", "shown_balance")
    assert shown == [("a", 100.0, 0.0, 100.0), ("b", 5.0, 60.0, 0.0), ("c", 100.0, None, None), ("d", 100.0, 100.0, 0.0)]


def test_intake_refuses_other_spellings_of_a_number(spark):
    ddl = "id int, phone string, email string"
    known = spark.createDataFrame([(1, "+233 240000001", "a@x.org")], ddl)
    batch = spark.createDataFrame(
        [(10, "0240000001", "n@x.org"), (11, "0240000002", "A@x.org "), (12, "0240000003", "m@x.org"),
         (13, "233240000003", "k@x.org"), (14, "0240000005", None)], ddl)
    good, bad = L.intake_customers(known, batch)
    assert rows(good, "id") == [(12,), (14,)]
    assert rows(bad, "id", "reasons") == [(10, ["duplicate phone"]), (11, ["duplicate email"]), (13, ["duplicate phone"])]


def test_a_refused_row_blocks_nobody(spark):
    random.seed(5)
    people = loads.load_customers(spark.createDataFrame([("c", "0240000001", "in@x.y")], "id string, phone string, email string"))
    batch = [(n, f"02400{random.randrange(60):05d}" if random.random() < 0.9 else None,
              f"u{random.randrange(60)}@x.y" if random.random() < 0.9 else " ") for n in range(150)]
    batch += [(200, "+233240000001", "u200@x.y"), (201, "0249999999", "U200@x.y ")]
    phones, mails, taken, refused = {"240000001"}, {"in@x.y"}, [], []
    for n, phone, mail in batch:
        key, mail = (phone or "")[-9:], mail.strip().lower()
        why = ["duplicate phone"] * bool(key and key in phones) + ["duplicate email"] * bool(mail and mail in mails)
        if why:
            refused.append((n, why))
        else:
            taken.append((n,))
            phones.add(key), mails.add(mail)
    good, bad = L.intake_customers(people, spark.createDataFrame(batch, "id long, phone string, email string"))
    assert rows(good, "id") == sorted(taken, key=str) and rows(bad, "id", "reasons") == sorted(refused, key=str)
    assert (201,) in taken  # 200 was refused, so its e-mail is still free


def test_rejections_of_bulk_jobs(spark):
    items = make_items(spark, ("a", "Sorting", None, False, None))
    asked = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "request_id string, item_id string")
    assert rows(L.unknown_requests(asked, items, "item_id", "unknown item"), "request_id") == [("2",), ("3",)]
    orders = spark.createDataFrame([("1", ["a", "b", "b"]), ("2", None)], "request_id string, item_ids array<string>")
    assert rows(L.unknown_claims(items, orders), "request_id", "item_id") == [("1", "b")]
    patches = spark.createDataFrame(
        [("a", "status", "x", 1), ("b", "status", "x", 1), ("a", "size", "x", 1), ("a", None, "x", 1)],
        "id string, field string, value string, seq int")
    assert rows(L.unknown_patches(items, patches), "id", "field", "reason") == [
        ("a", "size", "unknown field"), ("a", None, "unknown field"), ("b", "status", "unknown row")]


def test_patches_clear_and_keep(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    patches = spark.createDataFrame([(1, "name", None, 2), (1, "name", "x", 1), (2, "n", "7", 1)],
                                    "id int, field string, value string, seq int")
    assert rows(L.patch_rows(target, patches)) == [(1, None, 5), (2, "b", 7)]


def test_rates_and_settings(spark):
    ddl = "tier string, sea double, air double"
    got = L.upsert_rates(spark.createDataFrame([("a", 1.0, 2.0)], ddl), spark.createDataFrame([("a", 3.0, None), ("b", 4.0, 5.0)], ddl))
    assert rows(got) == [("a", 3.0, 2.0), ("b", 4.0, 5.0)]
    ddl = "usd_to_local double, rate_per_cbm double"
    new = spark.createDataFrame([(2.0, 9.0)], ddl)
    assert rows(L.save_settings(spark.createDataFrame([], ddl), new)) == [(2.0, 9.0)]
    assert rows(L.save_settings(spark.createDataFrame([(1.0, 1.0)], ddl), new)) == [(2.0, 9.0)]


def test_refs_continue_after_highest(spark):
    old = spark.createDataFrame([("ORD-00007",), ("ORD-99999",), ("SUP-5",)], "ref string")
    new = spark.range(1, 41).withColumn("k", F.lit(1))
    got = windows.assign_refs(new, old, "ORD-", 5, [("id", "asc")])
    assert [r[1] for r in got.orderBy("id").select("id", "ref").take(2)] == ["ORD-100000", "ORD-100001"]
    assert got.select("ref").distinct().count() == 40


def test_create_orders_links_items(spark):
    orders = make_orders(spark, ("ORD-00003", "Paid", 1.0, None, None))
    items = make_items(spark, ("a", "Sorting", None, False, None), ("b", "Sorting", None, False, "old"))
    asked = spark.createDataFrame(
        [("q1", "c", ["a", "b"], 5.0, NOW, None, NOW), ("q2", "c", ["b"], 6.0, NOW, "n", NOW + dt.timedelta(1))],
        "request_id string, customer_id string, item_ids array<string>, invoice_amount double, "
        "invoice_date timestamp_ntz, notes string, requested_at timestamp_ntz")
    new, linked = L.create_orders(orders, items, asked)
    assert rows(new, "id", "order_ref", "status", "notes") == [("q1", "ORD-00004", "Pending", ""), ("q2", "ORD-00005", "Pending", "n")]
    assert rows(linked, "id", "order_id") == [("a", "q1"), ("b", "q2")]


def test_timeline(spark):
    items = make_items(spark, ("a", "Arrived in Ghana", "k", False, None)).withColumn("date_received", F.lit(NOW).cast("timestamp_ntz"))
    past = spark.createDataFrame(
        [("h1", "a", "Shipped to Ghana", NOW), ("h2", "a", "Shipped to Ghana", NOW - dt.timedelta(1))],
        "id string, record_id string, new_status string, changed_at timestamp_ntz")
    boxes = spark.createDataFrame([("k", NOW)], "id string, eta timestamp_ntz")
    got = rows(audit.item_timeline(items, past, boxes), "step_no", "state", "reached_at", "eta")
    assert got[:3] == [(0, "completed", NOW, None), (1, "completed", NOW - dt.timedelta(1), NOW), (2, "current", None, None)]
    assert [r[1] for r in got[3:]] == ["pending"] * 3


def test_log_text(spark):
    logs = loads.load_activity_logs(spark.createDataFrame(
        [("1", "rec01 moved rec02, not rec99"), ("2", "rec02"), ("3", "nothing")], "id string, details string"))
    people = spark.createDataFrame([("rec01", "Ama", ""), ("rec03", "X", "M")], "id string, name string, shipping_mark string")
    things = spark.createDataFrame([("rec02", "ITM-2")], "id string, item_ref string")
    got = rows(audit.resolve_log_ids(logs, people, things, "rec[0-9]{2}"), "id", "details")
    assert got == [("1", "Ama moved ITM-2, not rec99"), ("2", "ITM-2"), ("3", "nothing")]


def test_versioned_writes(spark, tmp_path):
    root = str(tmp_path / "t")
    ddl = "id int, name string"
    assert tables.current_version(spark, root) is None
    assert tables.write_rows(spark, root, spark.createDataFrame([(1, "a"), (2, "b")], ddl)) == 1
    assert tables.write_rows(spark, root, spark.createDataFrame([(2, "c"), (3, None)], ddl)) == 2
    assert rows(tables.read_version(spark, root)) == [(1, "a"), (2, "c"), (3, None)]
    assert tables.remove_rows(spark, root, spark.createDataFrame([(1,)], "id int")) == 3
    assert rows(tables.read_version(spark, root), "id") == [(2,), (3,)]
    assert rows(tables.read_version(spark, root, 1)) == [(1, "a"), (2, "b")]


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    root, ddl = str(tmp_path / "t"), "id int, name string"
    tables.write_rows(spark, root, spark.createDataFrame([(1, "a")], ddl))
    read = tables.read_version(spark, root)
    assert tables.write_rows(spark, root, spark.createDataFrame([(2, "b")], ddl)) == 2
    with pytest.raises(tables.Conflict):  # built on version 1, which is no longer the newest
        tables.publish(tables.upsert_rows(read, spark.createDataFrame([(3, "c")], ddl)), root, 2)
    assert rows(tables.read_version(spark, root)) == [(1, "a"), (2, "b")]
    turns = []

    def step(now):
        if not turns:  # another writer is faster the first time
            turns.append(tables.publish(tables.upsert_rows(now, spark.createDataFrame([(4, "d")], ddl)), root, 3))
        return tables.upsert_rows(now, spark.createDataFrame([(3, "c")], ddl))

    assert tables.change(spark, root, step) == 4
    assert rows(tables.read_version(spark, root), "id") == [(1,), (2,), (3,), (4,)]


def test_repeated_keys_give_one_row(spark, tmp_path):
    root, ddl = str(tmp_path / "t"), "id int, name string, seq int"
    tables.write_rows(spark, root, spark.createDataFrame([(1, "a", 0)], ddl))
    twice = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, None, 3), (2, "x", 1), (2, "x", 1)], ddl)
    tables.write_rows(spark, root, twice, order=[F.col("seq")])
    assert rows(tables.read_version(spark, root)) == [(1, "a", 3), (2, "x", 1)]
    with pytest.raises(Exception, match="several different rows of key 1"):
        tables.write_rows(spark, root, twice)
    tables.write_rows(spark, root, twice.filter("id = 2"))
    assert rows(tables.read_version(spark, root)) == [(1, "a", 3), (2, "x", 1)]


def test_scan_with_schema(spark, tmp_path):
    path = str(tmp_path / "w.json")
    spark.createDataFrame([("w", "Dock", True)], "id string, name string, is_active boolean").write.json(path)
    df = tables.scan_table(spark, path, "warehouses", "json", where=F.col("is_active"), sort=("id",))
    assert df.columns[:3] == ["id", "name", "address"] and df.count() == 1
