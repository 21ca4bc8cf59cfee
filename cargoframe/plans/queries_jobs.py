"""Lifecycle jobs, pricing, invoices, audit, quality checks and feeds."""

import uuid

from pyspark.sql import functions as F

from cargoframe.functions.measures import cbm_unit, cube_side, discount_amount
from cargoframe.functions.text import reference
from cargoframe.operators import audit, lifecycle, pricing, quality, throttle, unions
from cargoframe.operators.skew import shared_folder
from cargoframe.plans.registry import STRAY_SQL, stray_orders
from cargoframe.plans.registry import FX, plain, query
from cargoframe.plans.views import e164_sql, mark_sql, step_sql
from cargoframe.sources import fixtures as X
from cargoframe.streaming import feeds

# I. lifecycle ---------------------------------------------------------------------------

_REASON = f"""CASE WHEN a.role = 'warehouse_staff' AND {step_sql('a.new_status')} < {step_sql('w.status')}
  THEN 'status can only move forward'
  WHEN a.new_status = 'Shipped to Ghana' AND a.container_id IS NULL THEN 'no container' END"""
_STATUS = f"""
WITH RECURSIVE asked AS (SELECT r.*, i.id AS known, i.status AS stored, i.container_id, i.customer_id, i.order_id,
 i.is_missing, row_number() OVER (PARTITION BY item_id ORDER BY requested_at, request_id) AS rn
 FROM t_status_requests r LEFT JOIN t_items i ON i.id = r.item_id),
walk AS (SELECT item_id, 0 AS rn, stored AS status, '' AS previous_status, CAST(NULL AS VARCHAR) AS reason,
  is_missing, '' AS request_id FROM asked WHERE rn = 1 AND known IS NOT NULL
 UNION ALL SELECT a.item_id, CAST(a.rn AS INT), CASE WHEN {_REASON} IS NULL THEN a.new_status ELSE w.status END,
  w.status, {_REASON}, w.is_missing AND NOT ({_REASON} IS NULL AND a.new_status IN
   ('Arrived in Ghana', 'Sorting', 'Ready for Pickup', 'Completed')), a.request_id
 FROM walk w JOIN asked a ON a.item_id = w.item_id AND a.rn = w.rn + 1),
judged AS (SELECT a.*, w.previous_status, CASE WHEN a.known IS NULL THEN 'unknown item' ELSE w.reason END AS reason
 FROM asked a LEFT JOIN walk w ON w.item_id = a.item_id AND w.rn = a.rn),
ends AS (SELECT item_id, max(rn) AS rn FROM walk GROUP BY 1)"""


def _status_change(spark, d):
    items = X.stored_items(
        spark, d, "id", "item_ref", "customer_id", "order_id", "container_id", "status", "is_missing",
        "tracking_number", "quantity", "date_received")
    return lifecycle.apply_item_status(items, X.status_requests(spark, d, items))


_STATUS_TABLE = f"""{_STATUS}
SELECT i.id, coalesce(w.status, i.status) AS status, coalesce(w.is_missing, i.is_missing) AS is_missing
FROM t_items i LEFT JOIN (SELECT walk.* FROM walk JOIN ends ON ends.item_id = walk.item_id AND ends.rn = walk.rn) w
 ON w.item_id = i.id"""


@query("i1_apply_item_status", _STATUS_TABLE)
def _(spark, d):
    return _status_change(spark, d).table.select("id", "status", "is_missing")


@query("i1_rejected_requests", f"{_STATUS} SELECT request_id, item_id, reason FROM judged WHERE reason IS NOT NULL")
def _(spark, d):
    return _status_change(spark, d).rejected


@query("i1_status_history", f"""{_STATUS}
SELECT request_id, item_id AS record_id, previous_status, new_status FROM judged WHERE reason IS NULL""")
def _(spark, d):
    return _status_change(spark, d).accepted.select(
        "request_id", F.col("id").alias("record_id"), "previous_status", "new_status")


_BOXES = """
WITH asked AS (SELECT r.*, CASE new_status WHEN 'Shipped to Ghana' THEN 'Shipped to Ghana'
  WHEN 'Arrived in Ghana' THEN 'Sorting' END AS target FROM t_box_requests r
 WHERE container_id IN (SELECT id FROM v_containers)),
ends AS (SELECT container_id, arg_max(new_status, requested_at) AS status,
 arg_max(arrival_date, requested_at) FILTER (WHERE arrival_date IS NOT NULL) AS arrival_date,
 arg_max(target, requested_at) FILTER (WHERE target IS NOT NULL) AS target FROM asked GROUP BY 1)"""


def _boxes(spark, d, log_history=False):
    return lifecycle.cascade_container_status(
        X.containers(spark, d), X.items(spark, d), X.box_requests(spark, d), log_history)


@query("i2_cascade_container_status", f"""{_BOXES}
SELECT i.id, coalesce(e.target, i.status) AS status FROM t_items i LEFT JOIN ends e ON e.container_id = i.container_id""")
def _(spark, d):
    return _boxes(spark, d).items.select("id", "status")


@query("i2_cascaded_containers", f"""{_BOXES}
SELECT c.id, coalesce(e.status, c.status) AS status, TS(e.arrival_date) AS arrival_date
FROM v_containers c LEFT JOIN ends e ON e.container_id = c.id""")
def _(spark, d):
    return plain(_boxes(spark, d).containers, "id", "status", "arrival_date")


@query("i2_cascade_history", f"""{_BOXES},
steps AS (SELECT container_id, target, requested_at,
 lag(target) OVER (PARTITION BY container_id ORDER BY requested_at, request_id) AS before
 FROM asked WHERE target IS NOT NULL)
SELECT i.id AS record_id, coalesce(s.before, i.status) AS previous_status, s.target AS new_status,
 TS(s.requested_at) AS changed_at FROM t_items i JOIN steps s ON s.container_id = i.container_id""")
def _(spark, d):
    return plain(_boxes(spark, d, True).history, "record_id", "previous_status", "new_status", "changed_at")


@query("i2_rejected_requests", """
SELECT request_id, CAST(container_id AS VARCHAR) AS container_id, 'unknown container' AS reason
FROM t_box_requests r WHERE NOT EXISTS (SELECT 1 FROM v_containers c WHERE c.id = r.container_id)""")
def _(spark, d):
    return _boxes(spark, d).rejected


_TARGET = """CASE c.status WHEN 'Shipped to Ghana' THEN 'Shipped to Ghana'
 WHEN 'Arrived in Ghana' THEN 'Sorting' END"""


@query("i3_sync_container_items", f"""
SELECT i.id, coalesce({_TARGET}, i.status) AS status
FROM t_items i LEFT JOIN v_containers c ON c.id = i.container_id""")
def _(spark, d):
    table, _counts = lifecycle.sync_container_items(X.containers(spark, d), X.items(spark, d))
    return table.select("id", "status")


@query("i3_sync_counts", f"""
SELECT c.id AS container_id, {_TARGET} AS target_status,
 CASE WHEN c.status = 'Loading' THEN 0 ELSE count(i.id) END AS updated
FROM v_containers c LEFT JOIN t_items i ON i.container_id = c.id GROUP BY c.id, c.status""")
def _(spark, d):
    return lifecycle.sync_container_items(X.containers(spark, d), X.items(spark, d))[1]


_LOADS = """
WITH items_once AS MATERIALIZED (SELECT id, container_id FROM t_items),
loads_once AS MATERIALIZED (SELECT * FROM t_loads),
valid AS MATERIALIZED (SELECT l.* FROM loads_once l WHERE EXISTS (SELECT 1 FROM v_containers c WHERE c.id = l.container_id)),
firsts AS (SELECT item_id, arg_min(container_id, (requested_at, request_id)) AS asked FROM valid GROUP BY 1),
placed AS MATERIALIZED (SELECT i.id, coalesce(i.container_id, f.asked) AS container_id, f.asked
 FROM items_once i LEFT JOIN firsts f ON f.item_id = i.id)"""


def _loading(spark, d):
    return lifecycle.load_items_to_container(
        X.items(spark, d), X.containers(spark, d), X.load_requests(spark, d))


@query("i4_load_items_to_container", f"""{_LOADS}
SELECT id, CAST(container_id AS VARCHAR) AS container_id FROM placed""")
def _(spark, d):
    return plain(_loading(spark, d).table, "id", "container_id", text=("container_id",))


@query("i4_load_rejections", f"""{_LOADS}
SELECT v.request_id, v.item_id, CASE WHEN p.id IS NULL THEN 'unknown item' ELSE 'in another container' END
 AS reason FROM valid v LEFT JOIN placed p ON p.id = v.item_id
WHERE p.id IS NULL OR p.container_id <> v.container_id
UNION ALL SELECT request_id, item_id, 'unknown container' FROM loads_once l
WHERE NOT EXISTS (SELECT 1 FROM v_containers c WHERE c.id = l.container_id)""")
def _(spark, d):
    return _loading(spark, d).rejected


@query("g2_load_rejections", f"""{_LOADS}
SELECT request_id, item_id FROM loads_once l WHERE NOT EXISTS (
 SELECT 1 FROM valid v JOIN placed p ON p.id = v.item_id AND p.container_id = v.container_id
 WHERE v.request_id = l.request_id)""")
def _(spark, d):
    accepted = _loading(spark, d).accepted
    return unions.load_rejections(X.load_requests(spark, d), accepted).select("request_id", "item_id")


@query("i5_unload_items", """
SELECT id, CAST(CASE WHEN id IN (SELECT item_id FROM t_loads) THEN NULL ELSE container_id END AS VARCHAR)
 AS container_id FROM t_items""")
def _(spark, d):
    df = lifecycle.unload_items(X.items(spark, d), X.load_requests(spark, d))
    return plain(df, "id", "container_id", text=("container_id",))


@query("i5_rejected_requests", """
SELECT request_id, item_id, 'unknown item' AS reason FROM t_loads l
WHERE NOT EXISTS (SELECT 1 FROM t_items i WHERE i.id = l.item_id)""")
def _(spark, d):
    asked = X.load_requests(spark, d).select("request_id", "item_id")
    return lifecycle.unknown_requests(asked, X.items(spark, d), "item_id", "unknown item").select(
        "request_id", "item_id", "reason")


def _sorted(spark, d):
    return lifecycle.mark_sorting(X.items(spark, d), X.sorting_actions(spark, d))


@query("i6_mark_sorting", """
WITH ends AS (SELECT item_id, bool_or(action = 'found') AS found, arg_max(action, (requested_at, request_id)) AS last
 FROM t_actions WHERE action IN ('found', 'missing') GROUP BY 1)
SELECT i.id, CASE WHEN a.found THEN 'Ready for Pickup' ELSE i.status END AS status,
 CASE a.last WHEN 'found' THEN FALSE WHEN 'missing' THEN TRUE ELSE i.is_missing END AS is_missing
FROM t_items i LEFT JOIN ends a ON a.item_id = i.id""")
def _(spark, d):
    return _sorted(spark, d).table.select("id", "status", "is_missing")


@query("i6_sorting_history", """
WITH finds AS (SELECT a.*, row_number() OVER (PARTITION BY item_id ORDER BY requested_at, request_id) AS rn
 FROM t_actions a WHERE action = 'found')
SELECT i.id AS record_id, CASE WHEN rn = 1 THEN i.status ELSE 'Ready for Pickup' END AS previous_status,
 'Ready for Pickup' AS new_status, TS(f.requested_at) AS changed_at FROM finds f JOIN t_items i ON i.id = f.item_id""")
def _(spark, d):
    return plain(_sorted(spark, d).history, "record_id", "previous_status", "new_status", "changed_at")


@query("i6_rejected_actions", """
SELECT request_id, item_id, 'unknown action' AS reason FROM t_actions WHERE action = 'lost'""")
def _(spark, d):
    return _sorted(spark, d).rejected


@query("i7_delete_cascade", """
SELECT id, CAST(CASE WHEN order_id IN (SELECT id FROM t_orders WHERE discount IS NOT NULL) THEN NULL
 ELSE order_id END AS VARCHAR) AS order_id FROM t_items""")
def _(spark, d):
    orders = X.orders(spark, d)
    tables = {"orders": orders, "items": X.items(spark, d)}
    gone = lifecycle.delete_cascade(tables, "order", orders.filter("discount IS NOT NULL"))
    return plain(gone["items"], "id", "order_id", text=("order_id",))


@query("i8_apply_payments", """
WITH sums AS (SELECT order_id, sum(amount_paid) AS paid FROM (
  SELECT order_id, amount_paid FROM v_payments
  UNION ALL SELECT order_id, CAST(250 AS DECIMAL(18,2)) FROM v_payments WHERE order_id % 4 = 0) q GROUP BY 1)
SELECT o.id, CASE WHEN s.paid IS NULL THEN o.status WHEN s.paid >= o.invoice_amount THEN 'Paid'
  ELSE 'Partial' END AS status,
 CAST(s.paid AS DOUBLE) AS amount_paid, CAST(greatest(0, o.invoice_amount - s.paid) AS DOUBLE) AS balance_due
FROM t_orders o LEFT JOIN sums s ON s.order_id = o.id""".replace(
    "CAST(greatest(0, o.invoice_amount - s.paid) AS DOUBLE)",
    "CASE WHEN s.paid IS NOT NULL THEN CAST(greatest(0, o.invoice_amount - s.paid) AS DOUBLE) END"))
def _(spark, d):
    base = X.payments(spark, d).select("order_id", F.col("amount_paid").alias("amount"))
    extra = base.filter("order_id % 4 = 0").withColumn("amount", F.lit(250).cast("decimal(18,2)"))
    df = lifecycle.apply_payments(X.orders(spark, d), base.unionByName(extra))
    return plain(df, "id", "status", "amount_paid", "balance_due")


@query("i8_rejected_payments", """
SELECT -order_id AS order_id, CAST(amount_paid AS DOUBLE) AS amount, 'unknown order' AS reason
FROM v_payments WHERE order_id % 10 = 1""")
def _(spark, d):
    key = F.col("order_id")
    stray = X.payments(spark, d).select(
        F.when(key % 10 == 1, -key).otherwise(key).alias("order_id"), F.col("amount_paid").alias("amount"))
    return plain(lifecycle.unknown_requests(stray, X.orders(spark, d), "order_id", "unknown order"),
                 "order_id", "amount", "reason")


_SYNC = """
WITH joined AS (SELECT o.*, s.total_amount, s.sale_paid, s.sale_balance,
 o.sale_id IS NOT NULL AND o.status IN ('Pending', 'Partial') AS wanted
 FROM t_sold o LEFT JOIN t_snapshots s ON s.sale_id = o.sale_id),
decided AS (SELECT *, CASE WHEN wanted AND total_amount IS NOT NULL THEN
 CASE WHEN sale_balance <= 0 THEN 'Paid' WHEN sale_paid > 0 THEN 'Partial' END END AS fresh FROM joined)"""


def _snapshots(spark, d):
    return lifecycle.parse_snapshots(X.snapshot_payloads(spark, d))


_SYNCED = f"{_SYNC} SELECT id, coalesce(fresh, status) AS status FROM decided"


@query("i9_sync_payment_status", _SYNCED)
def _(spark, d):
    return lifecycle.sync_payment_status(X.sold_orders(spark, d), _snapshots(spark, d))[0].select(
        "id", "status")


@query("i9_sync_counts", f"""{_SYNC}
SELECT count(*) FILTER (WHERE wanted) AS synced, count(*) FILTER (WHERE fresh <> status) AS updated,
 count(*) FILTER (WHERE wanted AND total_amount IS NULL) AS errors FROM decided""")
def _(spark, d):
    return lifecycle.sync_payment_status(X.sold_orders(spark, d), _snapshots(spark, d))[1]


@query("i10_payment_position", """
WITH j AS (SELECT o.*, CAST(invoice_amount AS DOUBLE) AS amt, o.sale_id IS NOT NULL AS sold,
 s.total_amount AS t, s.sale_paid AS p, s.sale_balance AS b
 FROM t_sold o LEFT JOIN t_snapshots s ON s.sale_id = o.sale_id),
f AS (SELECT *, CASE WHEN sold AND t IS NULL THEN amt ELSE t END AS t2,
 CASE WHEN sold AND t IS NULL THEN CASE WHEN status = 'Paid' THEN amt ELSE 0 END ELSE p END AS p2,
 CASE WHEN sold AND t IS NULL THEN CASE WHEN status = 'Paid' THEN 0 ELSE amt END ELSE b END AS b2 FROM j),
g AS (SELECT *, sold AND status = 'Paid' AND coalesce(p2, 0) = 0 AS settle,
 sold AND status = 'Partial' AND coalesce(p2, 0) = 0 AND coalesce(t2, 0) <> 0 AS derive FROM f)
SELECT id AS order_id, status, R2(coalesce(t2, amt)) AS shown_total,
 R2(coalesce(CAST(amount_paid AS DOUBLE), CASE WHEN settle THEN amt WHEN derive THEN t2 - coalesce(b2, t2)
  ELSE p2 END)) AS shown_paid,
 R2(coalesce(CAST(balance_due AS DOUBLE), CASE WHEN settle THEN 0 ELSE b2 END)) AS shown_balance FROM g""")
def _(spark, d):
    df = lifecycle.payment_position(X.sold_orders(spark, d), _snapshots(spark, d))
    return plain(df, round_to=2)


def _created(spark, d):
    """An order for every item that has none yet."""
    loose = X.items(spark, d).filter("order_id IS NULL")
    today = F.lit("2001-08-01").cast("timestamp_ntz")
    requests = loose.select(
        F.concat(F.lit("N"), "id").alias("request_id"), "customer_id",
        F.array("id").alias("item_ids"), F.col("weight").alias("invoice_amount"),
        today.alias("invoice_date"), F.lit(None).cast("string").alias("notes"),
        today.alias("requested_at"))
    ref = reference("ORD-", F.col("id"), 5)
    items = X.items(spark, d).withColumn("order_id", F.col("order_id").cast("string"))
    return lifecycle.create_orders(X.orders(spark, d).withColumn("order_ref", ref), items, requests)


@query("i11_create_orders", """
SELECT q.id, concat('ORD-', lpad(CAST(m.n + rn AS VARCHAR),
 CAST(greatest(5, length(CAST(m.n + rn AS VARCHAR))) AS INT), '0')) AS order_ref, customer_id,
 CAST(amount AS DOUBLE) AS invoice_amount, 'Pending' AS status, CAST(1 AS INTEGER) AS item_count
FROM (SELECT concat('N', id) AS id, customer_id, CAST(weight AS DECIMAL(18,2)) AS amount,
 row_number() OVER (ORDER BY concat('N', id)) AS rn FROM t_items WHERE order_id IS NULL) q
CROSS JOIN (SELECT max(id) AS n FROM t_orders) m""")
def _(spark, d):
    new = _created(spark, d)[0].withColumn("item_count", F.size("item_ids"))
    return plain(new, "id", "order_ref", "customer_id", "invoice_amount", "status", "item_count")


@query("i11_linked_items", """
SELECT id, coalesce(CAST(order_id AS VARCHAR), concat('N', id)) AS order_id FROM t_items""")
def _(spark, d):
    return _created(spark, d)[1].select("id", "order_id")


@query("i11_rejected_claims", """
SELECT request_id, item_id, 'unknown item' AS reason FROM t_status_requests r
WHERE NOT EXISTS (SELECT 1 FROM t_items i WHERE i.id = r.item_id)""")
def _(spark, d):
    claims = X.status_requests(spark, d).select("request_id", F.array("item_id").alias("item_ids"))
    return lifecycle.unknown_claims(X.items(spark, d), claims).select("request_id", "item_id", "reason")


@query("i12_regenerate_marks", f"""
SELECT id, name, '' AS old_mark, CASE WHEN id % 10 = 0 THEN concat('VIP-', CAST(id AS VARCHAR))
 ELSE {mark_sql('name', 'phone', 'NEW-')} END AS new_mark, '' AS old_address,
 CASE WHEN id % 10 = 0 THEN '' ELSE concat({mark_sql('name', 'phone', 'NEW-')}, ', Dock 4') END AS new_address
FROM t_customers""")
def _(spark, d):
    people = X.customers(spark, d).withColumn("shipping_mark", F.lit(""))
    vip = people.filter("id % 10 = 0").select(
        "id", F.concat(F.lit("VIP-"), F.col("id").cast("string")).alias("mark"))
    return lifecycle.regenerate_marks(people, "NEW-", "Dock 4", vip)


# Chains of rows in which each shares its number or its e-mail with the one before, eight at most;
# every eleventh has the e-mail of a customer, and every fifth customer is sent in again.
_INTAKE = """
WITH RECURSIVE batch AS (SELECT id, id % 11 = 0 AS known,
 id % 2 = 1 AS same_phone, id % 2 = 0 AND id % 8 <> 0 AND id % 11 <> 0 AND (id - 1) % 11 <> 0 AS same_email
 FROM t_customers),
walk AS (SELECT b.id, NOT b.known AS taken, FALSE AS bad_phone FROM batch b
  LEFT JOIN batch p ON p.id = b.id - 1 WHERE p.id IS NULL OR NOT (b.same_phone OR b.same_email)
 UNION ALL SELECT b.id, NOT b.known AND NOT w.taken, b.same_phone AND w.taken
 FROM walk w JOIN batch b ON b.id = w.id + 1 AND (b.same_phone OR b.same_email)),
judged AS (SELECT b.id + 1000000 AS id, w.taken, w.bad_phone, b.known OR (NOT w.taken AND NOT w.bad_phone) AS bad_email
 FROM walk w JOIN batch b ON b.id = w.id
 UNION ALL SELECT id + 2000000, FALSE, TRUE, FALSE FROM t_customers WHERE id % 5 = 0)"""


def _intake(spark, d):
    people = X.customers(spark, d).select("id", "phone", "email")
    key = F.col("id")

    def half(n):
        return F.floor(n / 2).cast("string")

    paired = F.concat(F.lit("pair"), half(key + 1), F.lit("@example.com"))
    alone = F.concat(F.lit("solo"), key.cast("string"), F.lit("@example.com"))
    fresh = people.select(
        (key + 1000000).alias("id"), F.concat(F.lit("055"), F.lpad(half(key), 7, "0")).alias("phone"),
        F.when(key % 11 == 0, F.upper("email")).when(key % 8 == 0, alone).otherwise(paired).alias("email"))
    again = people.filter("id % 5 = 0").select(
        (key + 2000000).alias("id"), "phone",
        F.concat(F.lit("again"), key.cast("string"), F.lit("@example.com")).alias("email"))
    return lifecycle.intake_customers(people, fresh.unionByName(again))


@query("i13_intake_customers", f"{_INTAKE} SELECT id FROM judged WHERE taken")
def _(spark, d):
    return _intake(spark, d)[0].select("id")


@query("i13_intake_rejections", f"""{_INTAKE}
SELECT id, CASE WHEN bad_phone AND bad_email THEN 'duplicate phone; duplicate email'
 WHEN bad_phone THEN 'duplicate phone' ELSE 'duplicate email' END AS reasons FROM judged WHERE NOT taken""")
def _(spark, d):
    return plain(_intake(spark, d)[1], "id", "reasons")


@query("i14_upsert_rates", """
SELECT coalesce(r.tier, u.tier) AS tier, coalesce(u.sea, r.sea) AS sea, coalesce(u.air, r.air) AS air
FROM v_rates r FULL OUTER JOIN (SELECT name AS tier, sea, air FROM v_special_rates
 UNION ALL SELECT 'business', CAST(count(*) AS DOUBLE), 9e0 FROM v_containers) u ON u.tier = r.tier""")
def _(spark, d):
    boxes = X.containers(spark, d).agg(F.count(F.lit(1)).cast("double").alias("sea"))
    updates = X.special_rates(spark, d).select(F.col("name").alias("tier"), "sea", "air").unionByName(
        boxes.select(F.lit("business").alias("tier"), "sea", F.lit(9.0).alias("air")))
    return lifecycle.upsert_rates(X.stored_rates(spark, d), updates)


@query("i15_patch_rows", """
SELECT id, CASE WHEN id % 3 = 0 THEN concat('Box ', CAST(id AS VARCHAR)) ELSE name END AS name,
 CASE WHEN id % 4 = 0 THEN NULL ELSE TS(eta) END AS eta,
 CASE WHEN id % 2 = 0 THEN 'Loading' ELSE status END AS status FROM v_containers""")
def _(spark, d):
    boxes = X.containers(spark, d).select("id", "name", "eta", "status")
    key = F.col("id")

    def patch(rows, field, value, seq=1):
        return rows.select("id", F.lit(field).alias("field"), value.alias("value"), F.lit(seq).alias("seq"))

    named = boxes.filter(key % 3 == 0)
    patches = (
        patch(named, "name", F.lit("first"))
        .unionByName(patch(named, "name", F.concat(F.lit("Box "), key.cast("string")), 2))
        .unionByName(patch(boxes.filter(key % 4 == 0), "eta", F.lit(None).cast("string")))
        .unionByName(patch(boxes.filter(key % 2 == 0), "status", F.lit("Loading"))))
    return plain(lifecycle.patch_rows(boxes, patches))


@query("i15_rejected_patches", """
SELECT -id - 1 AS id, 'name' AS field, 'unknown row' AS reason FROM v_containers WHERE id % 3 = 0
UNION ALL SELECT id, 'colour', 'unknown field' FROM v_containers WHERE id % 4 = 0""")
def _(spark, d):
    boxes = X.containers(spark, d).select("id", "name", "eta", "status")
    key = F.col("id")
    patches = boxes.filter(key % 3 == 0).select((-key - 1).alias("id"), F.lit("name").alias("field")).unionByName(
        boxes.filter(key % 4 == 0).select("id", F.lit("colour").alias("field"))).unionByName(
        boxes.select("id", F.lit("status").alias("field")))
    return lifecycle.unknown_patches(boxes, patches.withColumns({"value": F.lit("x"), "seq": F.lit(1)})).select(
        "id", "field", "reason")


@query("i16_close_registrations", f"""
SELECT id, CASE WHEN email IN (SELECT email FROM v_customers)
 OR {e164_sql('phone')} IN (SELECT {e164_sql('phone')} FROM v_customers)
 THEN 'Created' ELSE status END AS status FROM t_registrations""")
def _(spark, d):
    return lifecycle.close_registrations(X.registrations(spark, d), X.customers(spark, d)).select("id", "status")


# J. pricing -----------------------------------------------------------------------------


def _special_items(spark, d):
    """Items with the name of a special rate on every fifth piece count."""
    raw = X.raw_items(spark, d)
    parts = X.base(spark, d, "part").select("p_partkey", "p_type")
    tagged = raw.withColumn("_part", F.split_part("id", F.lit("-"), F.lit(2)).cast("bigint"))
    tagged = tagged.join(parts, tagged["_part"] == parts["p_partkey"])
    name = F.when(F.col("quantity") % 5 == 0, F.col("p_type"))
    return X.loads.load_items(tagged.withColumn("special_rate_name", name))


@query("j1_price_items", """
WITH p AS (SELECT i.*, r.sea, r.air, x.sea AS xsea, x.air AS xair FROM t_items i
 LEFT JOIN t_customers c ON c.id = i.customer_id
 JOIN t_rates r ON r.tier = coalesce(c.package, 'basic')
 LEFT JOIN v_special_rates x ON x.name = i.part_type AND i.quantity % 5 = 0),
q AS (SELECT *, CASE WHEN shipping_type = 'air' THEN weight * quantity * air
  ELSE cbm_unit * quantity * sea END AS cost,
 CASE WHEN shipping_type = 'air' THEN weight * quantity * xair
  ELSE cbm_unit * quantity * xsea END AS xcost FROM p)
SELECT id, R2(coalesce(CASE WHEN xcost > 0 THEN xcost END, CASE WHEN cost > 0 THEN cost END))
  AS est_shipping_price, R6(CASE WHEN cost > 0 THEN cost END) AS pkg_est_shipping,
 CASE WHEN shipping_type = 'air' THEN air ELSE sea END AS pkg_shipping_rate,
 CASE WHEN shipping_type = 'air' THEN xair ELSE xsea END AS special_shipping_rate,
 xsea IS NOT NULL AS is_special_item FROM q""")
def _(spark, d):
    df = pricing.price_items(_special_items(spark, d), X.customers(spark, d),
                             X.stored_rates(spark, d), X.special_rates(spark, d))
    return plain(df, "id", "est_shipping_price", "pkg_est_shipping", "pkg_shipping_rate",
                 "special_shipping_rate", "is_special_item")


@query("j2_reprice_items", """
WITH p AS (SELECT i.*, r.sea, r.air FROM t_items i LEFT JOIN t_customers c ON c.id = i.customer_id
 JOIN t_rates r ON r.tier = coalesce(c.package, 'basic')),
q AS (SELECT *, CASE WHEN shipping_type = 'air' THEN weight * quantity * air
  ELSE cbm_unit * quantity * sea END AS cost FROM p)
SELECT id, R2(CASE WHEN cost > 0 THEN cost END) AS est_shipping_price,
 CASE WHEN shipping_type = 'air' THEN air WHEN cbm_unit <> 0 THEN sea END AS pkg_shipping_rate FROM q""")
def _(spark, d):
    df = pricing.reprice_items(X.items(spark, d), X.customers(spark, d), X.stored_rates(spark, d))
    return plain(df, "id", "est_shipping_price", "pkg_shipping_rate")


@query("j3_estimate_position", """
SELECT id, CAST(coalesce(CASE WHEN quantity % 3 = 0 THEN CAST(weight * 5 AS DECIMAL(18,2)) END,
 CASE WHEN quantity % 2 = 0 THEN CAST(weight * 3 AS DECIMAL(18,2)) END, 0) AS DOUBLE) AS estimate_total
FROM t_items""")
def _(spark, d):
    q, w = F.col("quantity"), F.col("weight")
    items = X.items(spark, d).withColumns({
        "pkg_est_shipping": F.when(q % 2 == 0, (w * 3).cast("decimal(18,2)")),
        "est_shipping_price": F.when(q % 3 == 0, (w * 5).cast("decimal(18,2)")),
    })
    return plain(pricing.estimate_position(items))


def _label_sql(head: str, unit: str) -> str:
    return (
        f"concat({head}, CASE WHEN i.tracking_number IS NULL THEN '' "
        "ELSE concat(' [TRK: ', i.tracking_number, ']') END, "
        f"CASE WHEN i.cbm_total > 0 THEN concat(' [CBM: ', printf('%.4f', i.cbm_total), '{unit}') "
        "ELSE '' END)"
    )


_NET = """greatest(0e0, R2(R2(CAST(o.invoice_amount AS DOUBLE) * 12.5e0)
 - R2(CAST(CASE WHEN o.discount > 0 THEN o.discount ELSE 0 END AS DOUBLE) * 12.5e0)))"""
_INVOICE = f"""
WITH lines AS (SELECT o.id AS order_id, i.id AS item_id, {{share}} AS share, {_NET} AS net,
 CASE WHEN i.id IS NULL THEN concat('Freight - ', o.order_ref)
  ELSE {_label_sql("i.description", "m3]")} END AS item_name
 FROM t_orders o LEFT JOIN t_items i ON i.order_id = o.id {{extra}} WHERE o.status <> 'Paid'),
whole AS (SELECT *, CAST(floor(share * 1e9 + 0.5e0) AS BIGINT) AS units FROM lines),
totals AS (SELECT *, CAST(sum(units) OVER (PARTITION BY order_id) AS DOUBLE) AS total,
 count(*) OVER (PARTITION BY order_id) AS n,
 row_number() OVER (PARTITION BY order_id ORDER BY item_id DESC) AS from_end FROM whole),
priced AS (SELECT *, CASE WHEN from_end > 1 THEN CAST(
 R2(net * (CASE WHEN total > 0 THEN CAST(units AS DOUBLE) / total ELSE 1e0 / n END)) AS DECIMAL(18,2)) ELSE 0 END AS own
 FROM totals)
SELECT order_id, item_id, item_name, CAST(CASE WHEN from_end > 1 THEN own
 ELSE CAST(R2(net) AS DECIMAL(18,2)) - sum(own) OVER (PARTITION BY order_id) END AS DOUBLE) AS price
FROM priced"""


@query("j4_invoice_lines", _INVOICE.format(share="i.cbm_total", extra=""))
def _(spark, d):
    return plain(pricing.invoice_lines(X.orders(spark, d), X.items(spark, d), X.settings(spark, FX)))


@query("j5_invoice_lines_equal", f"""
SELECT o.id AS order_id, i.id AS item_id,
 CASE WHEN i.id IS NULL THEN concat('Freight - ', o.order_ref)
  ELSE {_label_sql("'Freight: ', i.description", " m3]")} END AS item_name,
 R2(CAST(o.invoice_amount AS DOUBLE) / count(*) OVER (PARTITION BY o.id)) AS price
FROM t_orders o LEFT JOIN t_items i ON i.order_id = o.id""")
def _(spark, d):
    return plain(pricing.invoice_lines_equal(X.orders(spark, d), X.items(spark, d)))


@query("j6_invoice_lines_quoted", _INVOICE.format(
    share="CASE WHEN count(q.price) OVER (PARTITION BY o.id) = count(i.id) OVER (PARTITION BY o.id) "
          "AND i.id IS NOT NULL THEN q.price ELSE i.cbm_total END",
    extra="LEFT JOIN (SELECT id, weight * 10 AS price FROM t_items WHERE order_id % 2 = 0 "
          "OR quantity % 2 = 0) q ON q.id = i.id"))
def _(spark, d):
    items = X.stored_items(
        spark, d, "id", "item_ref", "order_id", "description", "tracking_number", "quantity", "weight", "length", "width",
        "height", "dimension_unit")
    quoted = items.filter("order_id % 2 = 0 OR quantity % 2 = 0").select(
        F.col("id").alias("item_id"), (F.col("weight") * 10).alias("price"))
    return plain(pricing.invoice_lines_quoted(X.orders(spark, d), items, quoted, X.settings(spark, FX)))


@query("j7_volume_quotes", """
SELECT i.id, i.tier, R6(nullif(cbm_unit, 0)) AS cbm_single, R6(nullif(cbm_unit, 0) * quantity) AS cbm_all,
 R2(nullif(cbm_unit, 0) * quantity * coalesce(r.sea, b.sea)) AS price
FROM (SELECT *, CASE quantity % 4 WHEN 0 THEN 'business' WHEN 1 THEN 'gold' WHEN 2 THEN 'special' END AS tier
 FROM t_items) i LEFT JOIN t_rates r ON r.tier = i.tier CROSS JOIN (SELECT sea FROM t_rates WHERE tier = 'basic') b""")
def _(spark, d):
    q = F.col("quantity") % 4
    tier = F.when(q == 0, "business").when(q == 1, "gold").when(q == 2, "special")
    requests = X.items(spark, d).select(
        "id", "length", "width", "height", "dimension_unit", "quantity", tier.alias("tier"))
    df = pricing.volume_quotes(requests, X.stored_rates(spark, d))
    return plain(df, "id", "tier", "cbm_single", "cbm_all", "price")


@query("j7_cube_sides", """
SELECT id, R6(cbrt(cbm_unit * 1e6)) AS side FROM t_items WHERE cbm_unit > 0""")
def _(spark, d):
    df = X.items(spark, d).select("id", cube_side(cbm_unit()).alias("side")).filter("side IS NOT NULL")
    return plain(df, round_to=None)


@query("j8_landed_cost", """
WITH s AS (SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice AS product,
 l_quantity AS origin, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 10 * 350 ELSE l_quantity * 8 END
  AS freight, l_tax * 100 AS duty_pct FROM lineitem),
t AS (SELECT *, product + origin + freight AS subtotal FROM s)
SELECT id, line, R2(subtotal) AS subtotal, R2(subtotal * (duty_pct / 100)) AS duty,
 R2(subtotal + subtotal * (duty_pct / 100) + 25) AS total_usd,
 R2((subtotal + subtotal * (duty_pct / 100) + 25) * 12.5e0) AS total_local FROM t""")
def _(spark, d):
    q = F.col("l_quantity")
    shipments = X.base(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.col("l_extendedprice").alias("product"), q.alias("origin_freight"),
        F.when(F.col("l_linenumber") % 2 == 0, "sea").otherwise("air").alias("mode"),
        (q / 10).alias("cbm"), q.alias("weight"), F.lit(350.0).alias("sea_rate"),
        F.lit(8.0).alias("air_rate"), (F.col("l_tax") * 100).alias("duty_pct"),
        F.lit(25.0).alias("agent_fee"), F.lit(FX).alias("usd_to_local"))
    df = pricing.landed_cost(shipments)
    return plain(df, "id", "line", "subtotal", "duty", "total_usd", "total_local", round_to=2)


@query("j9_order_net_view", """
WITH o AS (SELECT id, CAST(invoice_amount AS DOUBLE) AS base,
 CASE WHEN discount IS NULL THEN 0 ELSE R2(CAST(invoice_amount AS DOUBLE) * 0.15e0) END AS disc,
 CAST(coalesce(amount_paid, 0) AS DOUBLE) AS paid FROM t_sold)
SELECT id AS order_id, R2(base) AS base_usd, R2(base * 12.5e0) AS base_local, R2(disc) AS discount_usd,
 R2(disc * 12.5e0) AS discount_local, R2(greatest(0, base - disc)) AS net_usd,
 R2(greatest(0, base - disc) * 12.5e0) AS net_local, R2(greatest(0, base * 12.5e0 - paid)) AS balance_local
FROM o""")
def _(spark, d):
    orders = X.sold_orders(spark, d)
    percent = F.when(F.col("discount").isNotNull(), F.lit(15.0))
    given = discount_amount(F.col("invoice_amount"), percent, F.lit("pct")).cast("decimal(18,2)")
    df = pricing.order_net_view(orders.withColumn("discount", given), X.settings(spark, FX))
    return plain(df, round_to=2)


# K. audit -------------------------------------------------------------------------------


@query("k1_item_history", """
SELECT h.id, h.record_id, h.new_status, TS(h.changed_at) AS changed_at FROM t_item_history h
WHERE h.record_id IN (SELECT id FROM t_items WHERE is_missing)""")
def _(spark, d):
    lost = X.items(spark, d).filter("is_missing").select("id")
    return plain(audit.item_history(X.item_history(spark, d), lost))


@query("k2_item_timeline", """
SELECT i.id AS item_id, CAST(s.step_no AS INTEGER) AS step_no, s.step,
 CASE WHEN s.step_no < i.step_no THEN 'completed' WHEN s.step_no = i.step_no THEN 'current'
  ELSE 'pending' END AS state,
 strftime(coalesce(CAST(h.at AS TIMESTAMP), CASE WHEN s.step_no = 0 AND i.step_no >= 0
  THEN i.date_received END), '%Y-%m-%d %H:%M:%S.%f') AS reached_at,
 CASE WHEN s.step_no = 1 THEN TS(c.eta) END AS eta
FROM t_items i CROSS JOIN t_steps s
LEFT JOIN (SELECT record_id, new_status, min(changed_at) AS at FROM t_item_history GROUP BY 1, 2) h
 ON h.record_id = i.id AND h.new_status = s.step
LEFT JOIN v_containers c ON c.id = i.container_id""")
def _(spark, d):
    return plain(audit.item_timeline(
        X.items(spark, d), X.item_history(spark, d), X.containers(spark, d)))


ID_PATTERN = "(?:CUS|BOX)[0-9]+"


@query("k3_resolve_log_ids", """
WITH tokens AS (SELECT id, unnest(regexp_extract_all(details, '(?:CUS|BOX)[0-9]+')) AS token,
  generate_subscripts(regexp_extract_all(details, '(?:CUS|BOX)[0-9]+'), 1) AS pos FROM v_logs),
texts AS (SELECT id, unnest(regexp_split_to_array(details, '(?:CUS|BOX)[0-9]+')) AS txt,
  generate_subscripts(regexp_split_to_array(details, '(?:CUS|BOX)[0-9]+'), 1) AS pos FROM v_logs),
named AS (SELECT t.id, t.pos, coalesce(c.shipping_mark, b.container_ref, t.token) AS label FROM tokens t
 LEFT JOIN t_customers c ON concat('CUS', CAST(c.id AS VARCHAR)) = t.token
 LEFT JOIN v_containers b ON concat('BOX', CAST(b.id AS VARCHAR)) = t.token)
SELECT x.id, string_agg(concat(x.txt, coalesce(n.label, '')), '' ORDER BY x.pos) AS details
FROM texts x LEFT JOIN named n ON n.id = x.id AND n.pos = x.pos GROUP BY x.id""")
def _(spark, d):
    people = X.customers(spark, d).withColumn(
        "id", F.concat(F.lit("CUS"), F.col("id").cast("string")))
    things = X.containers(spark, d).select(
        F.concat(F.lit("BOX"), F.col("id").cast("string")).alias("id"),
        F.col("container_ref").alias("item_ref"))
    df = audit.resolve_log_ids(X.logs(spark, d), people, things, ID_PATTERN)
    return df.select("id", "details")


@query("k4_notification_outbox", f"""{_STATUS}
SELECT j.request_id, j.item_id, j.customer_id, c.email, split_part(c.name, ' ', 1) AS first_name,
 CASE WHEN c.email IS NOT NULL THEN CASE j.new_status WHEN 'Arrived at Transit Warehouse'
   THEN 'We have received your parcel and will ship it soon.'
  WHEN 'Shipped to Ghana' THEN 'Your parcel has left in a container.'
  WHEN 'Arrived in Ghana' THEN 'Your parcel has arrived and is being processed.'
  WHEN 'Sorting' THEN 'Your parcel is being sorted for pickup.'
  WHEN 'Ready for Pickup' THEN 'Your parcel is waiting to be collected.'
  ELSE 'Your parcel has been handed over.' END END AS body,
 CASE WHEN c.email IS NOT NULL THEN CASE j.new_status WHEN 'Arrived at Transit Warehouse' THEN 'Parcel received'
  WHEN 'Shipped to Ghana' THEN 'Parcel on its way' WHEN 'Arrived in Ghana' THEN 'Parcel landed'
  WHEN 'Sorting' THEN 'Parcel in sorting' WHEN 'Ready for Pickup' THEN 'Parcel ready'
  ELSE 'Parcel delivered' END END AS headline,
 CASE WHEN j.order_id IS NOT NULL THEN concat('Hi ', c.name, '! Order ', j.order_id, ' has a new status: ',
  j.new_status, '.') END AS chat_text,
 CASE WHEN j.order_id IS NOT NULL THEN concat('+233', right(regexp_replace(c.phone, '[^0-9]', '', 'g'), 9))
  END AS chat_phone
FROM judged j JOIN (SELECT id, name, phone, CASE WHEN id % 13 <> 0 THEN email END AS email FROM t_customers) c
 ON c.id = j.customer_id WHERE j.reason IS NULL AND (c.email IS NOT NULL OR j.order_id IS NOT NULL)""")
def _(spark, d):
    people = X.customers(spark, d).withColumn("email", F.when(F.col("id") % 13 != 0, F.col("email")).otherwise(" "))
    return audit.notification_outbox(
        _status_change(spark, d).accepted, people, X.orders(spark, d), audit.default_templates(spark))


@query("k6_history_log", f"""{_STATUS}
SELECT CAST(record_id AS VARCHAR) AS record_id, '' AS previous_status, new_status,
 CAST(NULL AS VARCHAR) AS changed_by, TS(changed_at) AS changed_at FROM v_history
UNION ALL SELECT item_id, previous_status, new_status,
 CASE WHEN contains(actor, '@') THEN actor END, TS(requested_at) FROM judged WHERE reason IS NULL""")
def _(spark, d):
    old = X.history(spark, d).withColumns({
        "record_id": F.col("record_id").cast("string"), "changed_by": F.lit(None).cast("string")})
    df = audit.history_log(old, _status_change(spark, d).history)
    return plain(df, "record_id", "previous_status", "new_status", "changed_by", "changed_at")


@query("k7_activity_log", """
SELECT CAST(id AS VARCHAR) AS id, action, coalesce(user_email, '') AS user_email, '' AS entity_type
FROM v_logs
UNION ALL SELECT concat('E', CAST(event_id AS VARCHAR)), event_type,
 concat('user', CAST(user_id AS VARCHAR), '@example.com'), '' FROM events""")
def _(spark, d):
    old = X.logs(spark, d).withColumns({
        "id": F.col("id").cast("string"), "entity_type": F.lit("")})
    actions = X.base(spark, d, "events").select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("user_email"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"))
    return audit.activity_log(old, actions).select("id", "action", "user_email", "entity_type")


# L. quality -----------------------------------------------------------------------------


def _rules_sql(*rules: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in rules)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '; ')"


@query("l1_validate_items", f"""
SELECT id, {_rules_sql(
    ("width2 <= 0", "width not positive"), ("height2 > 10000", "height too large"),
    ("quantity > 10000", "quantity too large"),
    ("dimension_unit2 NOT IN ('cm', 'inches')", "dimension_unit unknown"),
    ("price > 500000 OR price < 0", "est_price out of range"))} AS violations
FROM (SELECT *, width - 12 AS width2, height * quantity * 11 AS height2,
 CASE WHEN quantity % 13 = 0 THEN 'feet' ELSE dimension_unit END AS dimension_unit2,
 CAST(l_extendedprice * 8 - 300000 AS DECIMAL(18,2)) AS price FROM t_items
 JOIN (SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_partkey AS VARCHAR), '-',
  CAST(l_suppkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-',
  CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS lid, l_extendedprice FROM lineitem) x ON lid = id) q""")
def _(spark, d):
    q = F.col("quantity")
    lines = X.base(spark, d, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in (
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
            F.col("l_quantity").cast("int").cast("string")).alias("id"), "l_extendedprice")
    items = X.items(spark, d).join(lines, "id").withColumns({
        "width": F.col("width") - 12, "height": F.col("height") * q * 11,
        "dimension_unit": F.when(q % 13 == 0, "feet").otherwise(F.col("dimension_unit")),
        "est_price": (F.col("l_extendedprice") * 8 - 300000).cast("decimal(18,2)"),
    })
    return plain(quality.validate_items(items), "id", "violations")


@query("l2_validate_customers", f"""
SELECT id, {_rules_sql(
    ("length(name2) < 2", "name too short"), ("length(phone2) < 7", "phone too short"),
    ("email2 NOT LIKE '%@%'", "email invalid"),
    ("package2 NOT IN ('basic', 'business', 'enterprise', 'special')", "package unknown"))} AS violations
FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'A' ELSE name END AS name2,
 CASE WHEN id % 5 = 0 THEN left(phone, 5) ELSE phone END AS phone2,
 CASE WHEN id % 3 = 0 THEN replace(email, '@', ' at ') ELSE email END AS email2,
 CASE WHEN id % 11 = 0 THEN 'gold' ELSE package END AS package2 FROM t_customers) q""")
def _(spark, d):
    key = F.col("id")
    people = X.customers(spark, d).withColumns({
        "name": F.when(key % 7 == 0, "A").otherwise(F.col("name")),
        "phone": F.when(key % 5 == 0, F.left("phone", F.lit(5))).otherwise(F.col("phone")),
        "email": F.when(key % 3 == 0, F.replace("email", F.lit("@"), F.lit(" at "))).otherwise(F.col("email")),
        "package": F.when(key % 11 == 0, "gold").otherwise(F.col("package")),
    })
    return plain(quality.validate_customers(people), "id", "violations")


@query("l3_validate_orders", f"""
SELECT id, {_rules_sql(
    ("id % 4 = 0", "at least one item is required"), ("amount <= 0", "invoice_amount not positive"),
    ("amount > 1000000", "invoice_amount too large"), ("status2 = 'Open'", "status unknown"),
    ("disc < 0", "discount negative"))} AS violations
FROM (SELECT id, invoice_amount * 3 - 100000 AS amount, -discount AS disc,
 CASE WHEN id % 6 = 0 THEN 'Open' ELSE status END AS status2 FROM t_orders) q""")
def _(spark, d):
    key = F.col("id")
    orders = X.orders(spark, d).withColumns({
        "item_ids": F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))),
        "invoice_amount": F.col("invoice_amount") * 3 - 100000,
        "discount": -F.col("discount"),
        "status": F.when(key % 6 == 0, "Open").otherwise(F.col("status")),
    })
    return plain(quality.validate_orders(orders), "id", "violations")


@query("l4_validate_containers", f"""
SELECT id, {_rules_sql(
    ("id % 2 = 0", "container number required"), ("id % 5 = 0", "status unknown"))} AS violations
FROM v_containers""")
def _(spark, d):
    key = F.col("id")
    boxes = X.containers(spark, d).withColumns({
        "tracking_number": F.when(key % 2 == 0, "").otherwise("MSKU1"),
        "status": F.when(key % 5 == 0, "Completed").otherwise(F.col("status")),
    })
    return plain(quality.validate_containers(boxes), "id", "violations")


@query("l5_validate_reference_data", """
SELECT 'suppliers' AS table_name, CAST(id AS VARCHAR) AS row_id, 'rating out of range' AS violations
FROM v_suppliers WHERE rating * 2 > 5
UNION ALL SELECT 'warehouses', CAST(id AS VARCHAR), 'address required' FROM v_warehouses
WHERE address = 'Dock 0'
UNION ALL SELECT 'special_rates', name, 'name required' FROM v_special_rates WHERE sea > 120
UNION ALL SELECT 'settings', 'settings', 'usd_to_local not positive'""")
def _(spark, d):
    dock = F.when(F.col("address") != "Dock 0", F.col("address")).otherwise(" ")
    rates = X.special_rates(spark, d)
    df = quality.validate_reference_data(
        X.suppliers(spark, d).withColumn("rating", F.col("rating") * 2),
        X.warehouses(spark, d).withColumn("address", dock),
        rates.withColumn("name", F.when(F.col("sea") <= 120, F.col("name"))),
        X.settings(spark, 0.0))
    return plain(df)


@query("l6_referential_check", """
SELECT id, customer_id FROM """ + STRAY_SQL + " stray WHERE customer_id NOT IN (SELECT id FROM t_customers)")
def _(spark, d):
    orders = stray_orders(X.orders(spark, d))
    return quality.referential_check(orders, X.customers(spark, d), "customer_id").select("id", "customer_id")


# M. feeds (batch forms) -----------------------------------------------------------------


@query("m1_status_change_feed", """
WITH moves AS (SELECT *, lag(new_status) OVER (PARTITION BY record_id ORDER BY changed_at, id) AS before
 FROM v_history),
news AS (SELECT *, row_number() OVER (PARTITION BY record_id, new_status ORDER BY changed_at, id) AS rn
 FROM moves WHERE before IS NOT NULL AND before <> new_status)
SELECT record_id, new_status, TS(changed_at) AS changed_at, id AS event_id FROM news WHERE rn = 1""")
def _(spark, d):
    return plain(feeds.status_changes(X.history(spark, d)))


@query("m2_rate_limit_labels", """
WITH RECURSIVE ev AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS us FROM events),
starts AS (SELECT key, min(us) AS us FROM ev GROUP BY key
 UNION ALL SELECT s.key, (SELECT min(e.us) FROM ev e WHERE e.key = s.key AND e.us > s.us + 86400000000)
 FROM starts s WHERE EXISTS (SELECT 1 FROM ev e WHERE e.key = s.key AND e.us > s.us + 86400000000)),
placed AS (SELECT e.id, e.key, e.us, max(s.us) AS opened FROM ev e JOIN starts s
 ON s.key = e.key AND s.us <= e.us GROUP BY 1, 2, 3)
SELECT id, key, row_number() OVER (PARTITION BY key, opened ORDER BY us, id) <= 2 AS allowed FROM placed""")
def _(spark, d):
    events = X.base(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return throttle.rate_limit_labels(events, 2, 86400).select("id", "key", "allowed")


@query("m2_rate_limit_stream", """
WITH RECURSIVE ev AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS us FROM events),
starts AS (SELECT key, min(us) AS us FROM ev GROUP BY key
 UNION ALL SELECT s.key, (SELECT min(e.us) FROM ev e WHERE e.key = s.key AND e.us > s.us + 86400000000)
 FROM starts s WHERE EXISTS (SELECT 1 FROM ev e WHERE e.key = s.key AND e.us > s.us + 86400000000)),
placed AS (SELECT e.id, e.key, e.us, max(s.us) AS opened FROM ev e JOIN starts s
 ON s.key = e.key AND s.us <= e.us GROUP BY 1, 2, 3)
SELECT id, concat('user-', CAST(key AS VARCHAR)) AS key, us,
 row_number() OVER (PARTITION BY key, opened ORDER BY us, id) <= 2 AS allowed FROM placed""")
def _(spark, d):
    events, root = _fed(spark, X.base(spark, d, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"),
        F.col("ts").alias("at")), "limits")
    feed = feeds.rate_limit_feed(events, 2, 86400)
    query = (feed.writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(feed.schema).parquet(f"{root}/out")


def _fed(spark, df, name):
    """Write a frame as the input of a stream: (stream, folder for its outputs)."""
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).parquet(f"{root}/in"), root


@query("m1_status_change_stream", """
WITH moves AS (SELECT *, lag(new_status) OVER (PARTITION BY record_id ORDER BY changed_at, id) AS before FROM v_history),
news AS (SELECT *, row_number() OVER (PARTITION BY record_id, new_status ORDER BY changed_at, id) AS rn
 FROM moves WHERE before IS NOT NULL AND before <> new_status)
SELECT concat('item-', CAST(record_id AS VARCHAR)) AS record_id, new_status, TS(changed_at) AS changed_at,
 concat('e', CAST(id AS VARCHAR)) AS event_id, FALSE AS late
FROM news WHERE rn = 1 AND changed_at < (SELECT max(changed_at) - INTERVAL 1 DAY FROM v_history)""")
def _(spark, d):
    text = X.history(spark, d).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("item-"), F.col("record_id").cast("string")).alias("record_id"), "new_status", "changed_at")
    events, root = _fed(spark, text, "alerts")
    query = (feeds.status_change_feed(events).writeStream.format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return plain(spark.read.schema(feeds.alert_schema(text)).parquet(f"{root}/out"))


@query("m3_transition_stream", _STATUS_TABLE)
def _(spark, d):
    columns = ["id", "item_ref", "customer_id", "order_id", "container_id", "status",
               "is_missing", "tracking_number", "description"]
    items = X.stored_items(spark, d, *columns, "quantity", "date_received")
    requests, root = _fed(spark, X.status_requests(spark, d, items), "transitions")
    store = feeds.item_store(items.select(*columns), f"{root}/items")
    feeds.transition_stream(requests, store.root, f"{root}/history", f"{root}/checkpoint").awaitTermination()
    return store.rows().select("id", "status", "is_missing")


@query("m4_payment_stream", _SYNCED)
def _(spark, d):
    timed = _snapshots(spark, d).withColumn("at", F.lit("2001-08-01").cast("timestamp"))
    snapshots, root = _fed(spark, timed.unionByName(timed), "payments")
    store = feeds.order_store(X.sold_orders(spark, d), f"{root}/orders")
    feeds.payment_stream(snapshots, store.root, f"{root}/late", f"{root}/checkpoint").awaitTermination()
    return store.rows().select("id", "status")
