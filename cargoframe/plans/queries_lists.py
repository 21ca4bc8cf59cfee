"""Loads, filters, searches, joins, pages and windows."""

from pyspark.sql import functions as F

from cargoframe.functions.text import reference
from cargoframe.operators import filters, links, listing, pricing, unions, windows
from cargoframe.plans import screens
from cargoframe.plans.registry import STRAY_SQL, stray_orders
from cargoframe.plans.registry import AS_OF, FROM, TO, plain, query
from cargoframe.sources import fixtures as X, loads, tables

# A. loads and writes --------------------------------------------------------------------


@query("a1_load_customers", """
SELECT id, name, phone, email, shipping_address, status, shipping_type, package,
 TS(created_at) AS created_at FROM t_customers""")
def _(spark, d):
    df = loads.load_customers(X.raw_customers(spark, d))
    return plain(df, "id", "name", "phone", "email", "shipping_address", "status",
                 "shipping_type", "package", "created_at")


@query("a2_load_items", """
SELECT id, item_ref, customer_id, CAST(order_id AS VARCHAR) AS order_id,
 CAST(container_id AS VARCHAR) AS container_id, status, is_missing, shipping_type, weight, length,
 dimension_unit, quantity, description, tracking_number, TS(date_received) AS date_received
FROM t_items""")
def _(spark, d):
    return plain(X.items(spark, d), "id", "item_ref", "customer_id", "order_id", "container_id",
                 "status", "is_missing", "shipping_type", "weight", "length", "dimension_unit",
                 "quantity", "description", "tracking_number", "date_received",
                 text=("order_id", "container_id"))


@query("a3_load_orders", """
SELECT id, order_ref, customer_id, CAST(invoice_amount AS DOUBLE) AS invoice_amount,
 CAST(discount AS DOUBLE) AS discount, status, TS(invoice_date) AS invoice_date,
 TS(created_at) AS created_at FROM t_orders""")
def _(spark, d):
    return plain(X.orders(spark, d), "id", "order_ref", "customer_id", "invoice_amount",
                 "discount", "status", "invoice_date", "created_at")


@query("a4_load_containers", """
SELECT id, container_ref, name, status, CAST(len(ids) AS INTEGER) AS item_count, TS(eta) AS eta
FROM (SELECT v.*, CASE WHEN id % 3 = 0 THEN ['a', 'b'] ELSE [] END AS ids FROM v_containers v) q""")
def _(spark, d):
    ids = F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b")))
    df = loads.load_containers(X.raw_containers(spark, d).withColumn("item_ids", ids))
    return plain(df, "id", "container_ref", "name", "status", "item_count", "eta")


@query("a5_load_status_history", """
SELECT id, 'Item' AS record_type, record_id, '' AS record_ref, new_status,
 'warehouse_staff' AS changed_by_role, TS(changed_at) AS changed_at FROM v_history""")
def _(spark, d):
    return plain(X.history(spark, d), "id", "record_type", "record_id", "record_ref",
                 "new_status", "changed_by_role", "changed_at")


@query("a6_load_activity_logs", """
SELECT id, action, coalesce(user_email, '') AS user_email, 'warehouse_staff' AS user_role, details,
 TS(timestamp) AS timestamp FROM v_logs""")
def _(spark, d):
    return plain(X.logs(spark, d), "id", "action", "user_email", "user_role", "details", "timestamp")


@query("a7_load_users", """
SELECT id, login_uid, email, role, CAST(customer_id AS VARCHAR) AS customer_id, customer_name,
 TS(last_login) AS last_login FROM t_users""")
def _(spark, d):
    raw = X.raw_users(spark, d).withColumn("customer_name", F.array("customer_name"))
    raw = raw.withColumn("customer_record", F.array("customer_id")).drop("customer_id")
    return plain(loads.load_users(raw), "id", "login_uid", "email", "role", "customer_id",
                 "customer_name", "last_login", text=("customer_id",))


@query("a8_load_suppliers", """
SELECT id, CAST(id AS VARCHAR) AS supplier_ref, name, category, platform, rating FROM v_suppliers""")
def _(spark, d):
    return plain(X.suppliers(spark, d), "id", "supplier_ref", "name", "category", "platform", "rating")


@query("a9_load_warehouses", """
SELECT id, name, address, is_active, TS(created_at) AS created_at FROM t_warehouses""")
def _(spark, d):
    return plain(X.warehouses(spark, d), "id", "name", "address", "is_active", "created_at")


@query("a10_load_registrations", """
SELECT id, name, phone, email, status, TS(submitted_at) AS submitted_at FROM t_registrations""")
def _(spark, d):
    return plain(X.registrations(spark, d), "id", "name", "phone", "email", "status", "submitted_at")


@query("a11_load_rates", """
SELECT name, sea, air, 12.5e0 AS usd_to_local, 300e0 AS rate_per_cbm FROM v_special_rates""")
def _(spark, d):
    df = loads.load_rates(X.special_rates(spark, d), X.settings(spark))
    return plain(df, "name", "sea", "air", "usd_to_local", "rate_per_cbm")


@query("a12_support_messages", """
SELECT conv_id AS ticket_id,
 CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS customer_messages,
 CAST(sum(CASE WHEN role = 'user' THEN 0 ELSE 1 END) AS BIGINT) AS admin_messages,
 CAST(sum(length(text)) AS BIGINT) AS characters,
 TS(max_day) AS last_activity
FROM conversations JOIN (SELECT conv_id AS c, DATE '2024-01-01' + CAST(max(turn) AS INT) AS max_day
 FROM conversations GROUP BY conv_id) m ON m.c = conv_id
GROUP BY conv_id, max_day""")
def _(spark, d):
    return plain(loads.support_threads(loads.support_messages(X.raw_tickets(spark, d))))


@query("a13_scan_table", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 200000""")
def _(spark, d):
    where = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)
    df = tables.scan_table(spark, f"{d}/orders.parquet", where=where)
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


@query("a14_write_rows", """
SELECT coalesce(o.id, n.id) AS id, coalesce(n.status, o.status) AS status,
 CAST(coalesce(n.invoice_amount, o.invoice_amount) AS DOUBLE) AS invoice_amount
FROM t_orders o FULL OUTER JOIN (
 SELECT CASE WHEN id % 9 = 0 THEN id + 100000000 ELSE id END AS id, 'Paid' AS status,
  CASE WHEN id % 2 = 0 THEN invoice_amount + 1 END AS invoice_amount
 FROM t_orders WHERE id % 3 = 0) n ON n.id = o.id""")
def _(spark, d):
    old = X.orders(spark, d).select("id", "status", "invoice_amount")
    key = F.col("id")
    new = old.filter(key % 3 == 0).select(
        F.when(key % 9 == 0, key + 100000000).otherwise(key).alias("id"),
        F.lit("Paid").alias("status"),
        F.when(key % 2 == 0, (F.col("invoice_amount") + 1).cast("decimal(18,2)")).alias("invoice_amount"),
    )
    return plain(tables.upsert_rows(old, new))


@query("a15_delete_rows", """
SELECT id, name FROM v_customers WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)""")
def _(spark, d):
    ids = X.raw_orders(spark, d).filter("invoice_amount > 480000").select(
        F.col("customer_id").alias("id"))
    return tables.delete_rows(X.customers(spark, d), ids).select("id", "name")


@query("a16_count_table", "SELECT count(*) AS n FROM v_items WHERE status = 'Sorting'")
def _(spark, d):
    return tables.count_table(X.items(spark, d), F.col("status") == "Sorting")


# B. filters -----------------------------------------------------------------------------


@query("b1_filter_items", """
SELECT id, customer_id, status FROM t_items
WHERE status = 'Completed' AND is_missing = FALSE AND container_id = 7""")
def _(spark, d):
    df = filters.filter_items(X.items(spark, d), status="Completed", is_missing=False, container_id=7)
    return df.select("id", "customer_id", "status")


@query("b2_search_items", """
SELECT i.id, c.shipping_mark AS customer_shipping_mark FROM t_items i
LEFT JOIN t_customers c ON c.id = i.customer_id
WHERE contains(lower(i.id), 'x00') OR contains(lower(description), 'x00')
 OR contains(lower(coalesce(tracking_number, '')), 'x00')
 OR contains(lower(coalesce(c.shipping_mark, '')), 'x00') OR contains(lower(coalesce(c.name, '')), 'x00')""")
def _(spark, d):
    df = links.items_with_customer(X.items(spark, d), X.customers(spark, d))
    return filters.search_items(df, "X00").select("id", "customer_shipping_mark")


@query("b3_search_customers", """
SELECT id, name, phone FROM t_customers WHERE status = 'active' AND (
 contains(lower(name), '+2332400001') OR contains(lower(email), '+2332400001')
 OR contains(lower(shipping_mark), '+2332400001') OR contains(phone, '+2332400001')
 OR contains(phone, '02400001'))""")
def _(spark, d):
    return filters.search_customers(X.customers(spark, d), "+2332400001", "active").select(
        "id", "name", "phone")


@query("b4_search_orders", """
SELECT o.id, c.name AS customer_name FROM t_orders o LEFT JOIN t_customers c ON c.id = o.customer_id
WHERE o.status = 'Partial' AND (contains(o.order_ref, '99') OR contains(lower(c.name), '99'))""")
def _(spark, d):
    df = links.orders_with_customer(X.orders(spark, d), X.customers(spark, d))
    return filters.search_orders(df, status="Partial", needle="99").select("id", "customer_name")


@query("b5_search_containers", """
SELECT id, container_ref, name FROM v_containers WHERE status = 'Shipped to Ghana'
 AND (contains(lower(container_ref), 'n-1') OR contains(lower(name), 'n-1'))""")
def _(spark, d):
    df = filters.search_containers(X.containers(spark, d), "Shipped to Ghana", "N-1")
    return df.select("id", "container_ref", "name")


@query("b6_search_suppliers", """
SELECT id, name, category, platform FROM v_suppliers WHERE category = 'Toys'
 AND (contains(lower(name), 'ta') OR contains(lower(category), 'ta') OR contains(lower(platform), 'ta'))""")
def _(spark, d):
    df = filters.search_suppliers(X.suppliers(spark, d), "TA", "Toys")
    return df.select("id", "name", "category", "platform")


@query("b7_search_any", """
SELECT id, description FROM t_items
WHERE contains(lower(description), 'blue r') OR contains(lower(coalesce(tracking_number, '')), 'blue r')""")
def _(spark, d):
    return filters.search_any(X.items(spark, d), ("description", "tracking_number"), "Blue R").select(
        "id", "description")


@query("b8_period_filter", """
SELECT 'today' AS period, count(*) AS n FROM t_items
 WHERE date_received >= TIMESTAMP '2001-08-01' AND date_received <= {AS_OF}
UNION ALL SELECT 'week', count(*) FROM t_items
 WHERE date_received >= {AS_OF} - INTERVAL 7 DAY AND date_received <= {AS_OF}
UNION ALL SELECT 'month', count(*) FROM t_items
 WHERE date_received >= {AS_OF} - INTERVAL 1 MONTH AND date_received <= {AS_OF}
UNION ALL SELECT 'year', count(*) FROM t_items
 WHERE date_received >= {AS_OF} - INTERVAL 1 YEAR AND date_received <= {AS_OF}
UNION ALL SELECT 'custom', count(*) FROM t_items
 WHERE date_received >= TIMESTAMP '1998-01-01' AND date_received < TIMESTAMP '1999-01-01'
UNION ALL SELECT 'all', count(*) FROM t_items""")
def _(spark, d):
    periods = ("today", "week", "month", "year", "custom", "all")
    tests = [filters.in_period(F.col("date_received"), p, AS_OF, FROM, TO) for p in periods]
    counts = X.items(spark, d).agg(*[F.count_if(t).alias(p) for p, t in zip(periods, tests)])
    return counts.unpivot([], list(periods), "period", "n")


@query("b9_report_range", "SELECT id, status FROM t_orders WHERE {RANGE}")
def _(spark, d):
    return filters.report_range(X.orders(spark, d), FROM, TO).select("id", "status")


@query("b10_scope_to_customer", """
SELECT id, customer_id FROM t_items WHERE customer_id IN (SELECT customer_id FROM t_users)""")
def _(spark, d):
    return filters.scope_to_customer(X.items(spark, d), X.users(spark, d)).select("id", "customer_id")


@query("b11_unloaded_items", """
SELECT id FROM t_items WHERE status = 'Arrived at Transit Warehouse' AND container_id IS NULL""")
def _(spark, d):
    return filters.unloaded_items(X.items(spark, d)).select("id")


@query("b12_uninvoiced_items", "SELECT id, customer_id FROM t_items WHERE order_id IS NULL")
def _(spark, d):
    return filters.uninvoiced_items(X.items(spark, d)).select("id", "customer_id")


@query("b13_staff_users", "SELECT id, role FROM t_users WHERE role IN ('super_admin', 'warehouse_staff')")
def _(spark, d):
    return filters.staff_users(X.users(spark, d)).select("id", "role")


@query("b14_active_warehouses", "SELECT id, name, TS(created_at) AS created_at FROM t_warehouses WHERE is_active")
def _(spark, d):
    return plain(filters.active_warehouses(X.warehouses(spark, d)), "id", "name", "created_at")


@query("b15_registrations_queue", """
SELECT id, TS(submitted_at) AS submitted_at, (SELECT count(*) FROM t_registrations
 WHERE status = 'Pending') AS pending FROM t_registrations WHERE status = 'Pending'""")
def _(spark, d):
    regs = X.registrations(spark, d)
    queue = filters.registrations_queue(regs, "Pending").select("id", "submitted_at")
    return plain(queue.crossJoin(F.broadcast(filters.pending_registrations(regs))))


@query("b16_match_customers", """
WITH probes AS (
 SELECT id AS probe_id, CASE WHEN id % 2 = 0 THEN 'phone' ELSE 'email' END AS kind,
  CASE WHEN id % 2 = 0 THEN phone ELSE email END AS value FROM t_registrations),
pairs AS (SELECT id, 'phone' AS kind, phone AS value FROM t_customers
 UNION ALL SELECT id, 'email', email FROM t_customers)
SELECT p.probe_id, p.kind, p.value, CAST(min(c.id) AS VARCHAR) AS customer_id
FROM probes p LEFT JOIN pairs c ON c.kind = p.kind AND c.value = p.value GROUP BY 1, 2, 3""")
def _(spark, d):
    even = F.col("id") % 2 == 0
    probes = X.registrations(spark, d).select(
        F.col("id").alias("probe_id"), F.when(even, "phone").otherwise("email").alias("kind"),
        F.when(even, F.col("phone")).otherwise(F.col("email")).alias("value"))
    return plain(filters.match_customers(X.customers(spark, d), probes), text=("customer_id",))


# C. joins -------------------------------------------------------------------------------


@query("c1_items_with_customer", """
SELECT i.id, CASE WHEN i.quantity % 3 = 0 THEN 'kept' ELSE c.name END AS customer_name,
 c.shipping_mark AS customer_shipping_mark
FROM t_items i LEFT JOIN t_customers c ON c.id = i.customer_id""")
def _(spark, d):
    items = X.items(spark, d).withColumn(
        "customer_name", F.when(F.col("quantity") % 3 == 0, "kept"))
    return links.items_with_customer(items, X.customers(spark, d)).select(
        "id", "customer_name", "customer_shipping_mark")


@query("c2_orders_with_customer", """
SELECT o.id, coalesce(c.name, 'stored') AS customer_name
FROM """ + STRAY_SQL + " o LEFT JOIN t_customers c ON c.id = o.customer_id")
def _(spark, d):
    orders = stray_orders(X.orders(spark, d)).withColumn("customer_name", F.lit("stored"))
    return links.orders_with_customer(orders, X.customers(spark, d)).select("id", "customer_name")


@query("c3_items_with_eta", """
SELECT i.id, TS(c.eta) AS container_eta FROM t_items i LEFT JOIN v_containers c ON c.id = i.container_id""")
def _(spark, d):
    return plain(links.items_with_eta(X.items(spark, d), X.containers(spark, d)), "id", "container_eta")


@query("c4_container_manifest", """
SELECT c.id AS container_id, c.container_ref, i.id, p.name AS customer_name,
 p.shipping_mark AS customer_shipping_mark
FROM v_containers c JOIN t_items i ON i.container_id = c.id
LEFT JOIN t_customers p ON p.id = i.customer_id""")
def _(spark, d):
    df = links.container_manifest(X.containers(spark, d), X.items(spark, d), X.customers(spark, d))
    return df.select("container_id", "container_ref", "id", "customer_name", "customer_shipping_mark")


@query("c5_order_detail", """
SELECT o.id AS order_id, CAST(o.invoice_amount AS DOUBLE) AS invoice_amount, i.id AS item_id, i.status
FROM t_orders o JOIN t_items i ON i.order_id = o.id""")
def _(spark, d):
    df = links.order_detail(X.orders(spark, d), X.items(spark, d))
    return plain(df.withColumn("item_id", F.col("id")), "order_id", "invoice_amount", "item_id", "status")


@query("c6_customer_profile", """
SELECT c.id, c.name, coalesce(i.n, 0) AS total_items, coalesce(o.n, 0) AS total_orders
FROM t_customers c LEFT JOIN (SELECT customer_id, count(*) AS n FROM t_items GROUP BY 1) i
 ON i.customer_id = c.id
LEFT JOIN (SELECT customer_id, count(*) AS n FROM t_orders GROUP BY 1) o ON o.customer_id = c.id""")
def _(spark, d):
    df = links.customer_profile(X.customers(spark, d), X.items(spark, d), X.orders(spark, d))
    return df.select("id", "name", "total_items", "total_orders")


@query("c7_users_with_customer", """
SELECT u.id, u.role, coalesce(u.customer_name, c.name) AS customer_name, c.shipping_mark, c.phone, c.package
FROM t_users u LEFT JOIN t_customers c ON c.id = u.customer_id AND u.role = 'customer'""")
def _(spark, d):
    return links.users_with_customer(X.users(spark, d), X.customers(spark, d)).select(
        "id", "role", "customer_name", "shipping_mark", "phone", "package")


@query("c8_containers_by_ids", """
SELECT id, container_ref FROM v_containers
WHERE id IN (SELECT container_id FROM t_items WHERE is_missing AND status = 'Sorting')""")
def _(spark, d):
    lost = X.items(spark, d).filter("is_missing AND status = 'Sorting'")
    ids = lost.select(F.col("container_id").alias("id"))
    return links.containers_by_ids(X.containers(spark, d), ids).select("id", "container_ref")


@query("c9_preferred_warehouse", """
WITH active AS (SELECT * FROM t_warehouses WHERE is_active),
oldest AS (SELECT * FROM active ORDER BY created_at, id LIMIT 1)
SELECT c.id AS customer_id, coalesce(w.id, o.id) AS warehouse_id, coalesce(w.name, o.name) AS warehouse_name
FROM t_customers c LEFT JOIN active w ON w.id = c.id % 31 CROSS JOIN oldest o""")
def _(spark, d):
    people = X.customers(spark, d).withColumn("preferred_warehouse_id", (F.col("id") % 31).cast("int"))
    df = links.preferred_warehouse(people, filters.active_warehouses(X.warehouses(spark, d)))
    return df.select("customer_id", "warehouse_id", "warehouse_name")


@query("c10_users_of_customers", """
SELECT id, email FROM t_users WHERE customer_id IN (SELECT id FROM v_customers WHERE status = 'inactive')""")
def _(spark, d):
    gone = X.customers(spark, d).filter("status = 'inactive'").select(F.col("id").alias("customer_id"))
    return links.users_of_customers(X.users(spark, d), gone).select("id", "email")


@query("c11_rate_card", "SELECT tier, sea, air FROM t_rates")
def _(spark, d):
    return links.rate_card(X.stored_rates(spark, d))


DIAL_CODES = ("+1", "+233", "+2332", "+234", "+44", "+1242", "+49", "0")


@query("c12_phone_country", """
SELECT id AS customer_id, phone,
 CASE WHEN phone LIKE '+2332%' THEN '+2332' WHEN phone LIKE '+233%' THEN '+233'
  WHEN phone LIKE '0%' THEN '0' ELSE '+233' END AS dial_code,
 CASE WHEN phone LIKE '+2332%' THEN trim(substr(phone, 6)) WHEN phone LIKE '+233%' THEN trim(substr(phone, 5))
  WHEN phone LIKE '0%' THEN trim(substr(phone, 2)) ELSE phone END AS local_number
FROM t_customers""")
def _(spark, d):
    return links.phone_country(X.customers(spark, d), DIAL_CODES)


@query("c13_link_users_by_email", """
SELECT l.login_uid, l.email, c.id AS customer_id
FROM (SELECT concat('uid-', CAST(id - 1000000 AS VARCHAR)) AS login_uid, email FROM t_registrations) l
JOIN (SELECT email, min(id) AS id FROM t_customers GROUP BY email) c ON c.email = l.email
WHERE l.login_uid NOT IN (SELECT login_uid FROM t_users)""")
def _(spark, d):
    logins = X.registrations(spark, d).select(
        F.concat(F.lit("uid-"), (F.col("id") - 1000000).cast("string")).alias("login_uid"), "email")
    return links.link_users_by_email(logins, X.users(spark, d), X.customers(spark, d))


# E. windows -----------------------------------------------------------------------------


@query("e1_dedupe_tracking", """
SELECT id, tracking_number, TS(date_received) AS date_received FROM (
 SELECT *, row_number() OVER (PARTITION BY tracking_number ORDER BY date_received DESC, id) AS rn
 FROM t_items) q WHERE rn = 1 OR tracking_number IS NULL""")
def _(spark, d):
    return plain(windows.dedupe_tracking(X.items(spark, d)), "id", "tracking_number", "date_received")


@query("e2_assign_refs", """
SELECT id, concat('ORD-', lpad(CAST(m.n + rn AS VARCHAR),
  CAST(greatest(length(CAST(m.n + rn AS VARCHAR)), 5) AS INT), '0')) AS ref
FROM (SELECT id, row_number() OVER (ORDER BY created_at, id) AS rn FROM t_orders) q
CROSS JOIN (SELECT max(id) AS n FROM t_customers) m""")
def _(spark, d):
    known = X.customers(spark, d).select(reference("ORD-", F.col("id"), 5).alias("ref"))
    new = X.orders(spark, d).select("id", "created_at")
    return windows.assign_refs(new, known, "ORD-", 5, [("created_at", "asc"), ("id", "asc")]).select("id", "ref")


@query("e3_invoice_line_no", """
SELECT order_id, id, row_number() OVER (PARTITION BY order_id ORDER BY id) AS line_no
FROM t_items WHERE order_id IS NOT NULL""")
def _(spark, d):
    lines = X.items(spark, d).filter("order_id IS NOT NULL").select("order_id", "id")
    return windows.invoice_line_no(lines, [("id", "asc")])


@query("e6_running_split", """
WITH lines AS (
 SELECT i.order_id, i.id, CAST(o.invoice_amount AS DOUBLE) AS net,
  CAST(CAST(floor(i.weight * 1e9 + 0.5e0) AS BIGINT) AS DOUBLE) AS share,
  CAST(sum(CAST(floor(i.weight * 1e9 + 0.5e0) AS BIGINT)) OVER w AS DOUBLE) AS total, count(*) OVER w AS n,
  row_number() OVER (PARTITION BY i.order_id ORDER BY i.id DESC) AS from_end
 FROM t_items i JOIN t_orders o ON o.id = i.order_id WINDOW w AS (PARTITION BY i.order_id)),
priced AS (SELECT *, CASE WHEN from_end > 1 THEN CAST(
  R2(net * (CASE WHEN total > 0 THEN share / total ELSE 1e0 / n END)) AS DECIMAL(18,2)) ELSE 0 END AS own
 FROM lines)
SELECT order_id, id, CAST(CASE WHEN from_end > 1 THEN own
 ELSE CAST(net AS DECIMAL(18,2)) - sum(own) OVER (PARTITION BY order_id) END AS DOUBLE) AS price
FROM priced""")
def _(spark, d):
    heads = X.orders(spark, d).select(F.col("id").alias("order_id"), "invoice_amount")
    lines = X.items(spark, d).select("order_id", "id", F.col("weight").alias("share")).join(heads, "order_id")
    return plain(windows.running_split(lines, "invoice_amount", "share", ["id"]), "order_id", "id", "price")


# F, G. lists ----------------------------------------------------------------------------


@query("f1_list_sorted", "SELECT id, TS(created_at) AS created_at FROM t_customers")
def _(spark, d):
    return plain(listing.list_sorted(X.customers(spark, d), "customers"), "id", "created_at")


# every table in its canonical order, with the time column of the fixtures (none: NULL)
_LISTED = {
    "items": ("t_items", "date_received DESC"), "customers": ("t_customers", "created_at DESC"),
    "orders": ("t_orders", "created_at DESC"), "containers": ("v_containers", "CAST(NULL AS DATE) DESC"),
    "suppliers": ("v_suppliers", "CAST(NULL AS DATE) DESC"), "users": ("t_users", "last_login DESC"),
    "registrations": ("t_registrations", "submitted_at DESC"), "warehouses": ("t_warehouses", "created_at"),
    "record_history": ("v_history", "changed_at"), "status_history": ("v_history", "changed_at DESC"),
    "activity_logs": ("v_logs", "timestamp DESC"),
}


@query("f1_positions", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY {order} NULLS LAST, id) "
    f"AS position FROM {view}" for name, (view, order) in _LISTED.items()))
def _(spark, d):
    made = {"record_history": X.history, "status_history": X.history, "activity_logs": X.logs}
    result = None
    for name in _LISTED:
        listed = listing.positions(made.get(name, getattr(X, name, None))(spark, d), name)
        listed = listed.select(F.lit(name).alias("table_name"), F.col("id").cast("string").alias("id"), "position")
        result = listed if result is None else result.unionByName(listed)
    return result


@query("h14_charge_basis", """
SELECT id, basis, CASE basis WHEN 'volume' THEN R6(cbm_total) WHEN 'weight' THEN R6(weight) END AS amount
FROM (SELECT *, CASE WHEN (shipping_type = 'sea' OR shipping_type IS NULL) AND cbm_unit <> 0 THEN 'volume'
 WHEN coalesce(weight, 0) <> 0 THEN 'weight' END AS basis FROM t_items) i""")
def _(spark, d):
    return plain(listing.charged_as(X.items(spark, d)), "id", "basis", "amount")


@query("h15_sale_dates", """
SELECT id, TS(issued) AS issue_date, TS(due) AS due_date
FROM (SELECT id, issued, issued + INTERVAL 30 DAY AS due FROM (
 SELECT id, CAST(coalesce(CAST(invoice_date AS DATE), DATE '2001-08-01') AS TIMESTAMP) AS issued FROM t_orders) o) d""")
def _(spark, d):
    return plain(pricing.sale_dates(X.orders(spark, d), AS_OF))


@query("f2_paginate", """
SELECT id, TS(date_received) AS date_received, (SELECT count(*) FROM t_items) AS total,
 CAST((SELECT ceil(count(*) / 40e0) FROM t_items) AS BIGINT) AS total_pages,
 (SELECT count(*) FROM t_items) > 120 AS has_more, CAST(81 AS BIGINT) AS from_row,
 CAST(120 AS BIGINT) AS to_row
FROM t_items ORDER BY t_items.date_received DESC, id LIMIT 40 OFFSET 80""")
def _(spark, d):
    items = X.items(spark, d)
    page = listing.paginate(items, 3, 40, listing.canonical_order("items"))
    info = listing.page_info(items, 3, 40)
    return plain(page.crossJoin(F.broadcast(info)), "id", "date_received", "total", "total_pages",
                 "has_more", "from_row", "to_row")


@query("f3_recent_orders", """
SELECT o.id, CAST(o.invoice_amount AS DOUBLE) AS invoice_amount,
 TS(shown) AS invoice_date, o.status, coalesce(n, 0) AS item_count
FROM (SELECT *, coalesce(invoice_date, created_at) AS shown FROM t_orders
 ORDER BY created_at DESC, id LIMIT 5) o
LEFT JOIN (SELECT order_id, count(*) AS n FROM t_items GROUP BY 1) i ON i.order_id = o.id""")
def _(spark, d):
    df = listing.recent_orders(X.orders(spark, d), X.items(spark, d))
    return plain(df, "id", "invoice_amount", "invoice_date", "status", "item_count")


@query("f4_recent_shipments", """
SELECT id, status, tracking_number, TS(date_received) AS date_received FROM t_items
ORDER BY t_items.date_received DESC, id LIMIT 5""")
def _(spark, d):
    return plain(listing.recent_shipments(X.items(spark, d)), "id", "status", "tracking_number", "date_received")


@query("f5_pending_orders", "SELECT id, TS(created_at) AS created_at FROM t_orders WHERE status = 'Pending'")
def _(spark, d):
    return plain(listing.pending_orders(X.orders(spark, d)), "id", "created_at")


@query("f6_outstanding_payments", """
SELECT o.id, o.order_ref, coalesce(c.name, 'Unknown') AS customer_name,
 CAST(o.invoice_amount AS DOUBLE) AS invoice_amount, TS(o.invoice_date) AS invoice_date, o.status
FROM {STRAY} o LEFT JOIN t_customers c ON c.id = o.customer_id
WHERE o.status IN ('Pending', 'Partial') AND {RANGE}""".replace("{STRAY}", STRAY_SQL).replace("{RANGE}", (
    "coalesce(o.invoice_date, o.created_at) >= TIMESTAMP '1998-01-01' "
    "AND coalesce(o.invoice_date, o.created_at) < TIMESTAMP '1999-01-01'")))
def _(spark, d):
    orders = stray_orders(X.orders(spark, d))
    return plain(listing.outstanding_payments(orders, X.customers(spark, d), FROM, TO))


@query("f7_latest_activity", """
SELECT id, action, TS(timestamp) AS timestamp FROM v_logs ORDER BY v_logs.timestamp DESC, id LIMIT 100""")
def _(spark, d):
    return plain(listing.latest_activity(X.logs(spark, d)), "id", "action", "timestamp")


@query("g1_sorting_board", """
WITH found AS (SELECT * FROM t_items WHERE contains(lower(description), 'ring')
 OR contains(lower(id), 'ring') OR contains(lower(coalesce(tracking_number, '')), 'ring'))
SELECT 'sorting' AS board, id FROM found WHERE status = 'Sorting'
UNION ALL SELECT 'missing', id FROM found WHERE is_missing""")
def _(spark, d):
    df = links.items_with_customer(X.items(spark, d), X.customers(spark, d))
    return unions.sorting_board(df, "ring").select("board", "id")


# whole read paths -----------------------------------------------------------------------


@query("item_list", """
WITH latest AS (SELECT i.*, row_number() OVER (PARTITION BY tracking_number
 ORDER BY date_received DESC, i.id) AS rn FROM t_items i WHERE status = 'Ready for Pickup')
SELECT l.id, c.name AS customer_name, TS(l.date_received) AS date_received, TS(b.eta) AS container_eta
FROM (SELECT * FROM latest WHERE (rn = 1 OR tracking_number IS NULL)
 AND date_received >= {AS_OF} - INTERVAL 1 YEAR AND date_received <= {AS_OF}
 ORDER BY date_received DESC, id LIMIT 50 OFFSET 50) l
LEFT JOIN t_customers c ON c.id = l.customer_id LEFT JOIN v_containers b ON b.id = l.container_id""")
def _(spark, d):
    df = screens.item_list(
        X.items(spark, d), X.customers(spark, d), X.containers(spark, d), needle="customer",
        period="year", as_of=AS_OF, page=2, status="Ready for Pickup")
    return plain(df, "id", "customer_name", "date_received", "container_eta")


@query("revenue_report_totals", """
SELECT (SELECT CAST(sum(invoice_amount) AS DOUBLE) FROM t_orders WHERE status = 'Paid' AND {RANGE})
  AS total_revenue,
 (SELECT count(*) FROM t_orders WHERE {RANGE}) AS total_orders, 0e0 AS revenue_this_year,
 (SELECT count(*) FROM t_items) AS total_shipments""")
def _(spark, d):
    parts = screens.revenue_report(
        X.orders(spark, d), X.customers(spark, d), X.items(spark, d), AS_OF, FROM, TO)
    return plain(parts["totals"], "total_revenue", "total_orders", "revenue_this_year", "total_shipments")
