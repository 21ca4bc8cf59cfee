"""Revenue, volume and dashboard reports."""

from pyspark.sql import functions as F

from cargoframe.operators import reports, windows
from cargoframe.plans.registry import STRAY_SQL, stray_orders
from cargoframe.plans.registry import AS_OF, FROM, TO, plain, query
from cargoframe.sources import fixtures as X

_PAID = "CASE WHEN status = 'Paid' THEN invoice_amount ELSE 0 END"


def _money(expression: str) -> str:
    return f"CAST(coalesce(sum({expression}), 0) AS DOUBLE)"


@query("d1_revenue_totals", f"""
SELECT {_money(_PAID)} AS total_revenue,
 {_money("CASE WHEN status = 'Pending' THEN invoice_amount ELSE 0 END")} AS pending_revenue,
 count(*) AS total_orders, count(*) FILTER (WHERE status = 'Paid') AS paid_orders,
 R4({_money(_PAID)} / count(*) FILTER (WHERE status = 'Paid')) AS avg_order_value
FROM t_orders WHERE {{RANGE}}""")
def _(spark, d):
    return plain(reports.revenue_totals(X.orders(spark, d), FROM, TO), round_to=4)


@query("d2_revenue_current", f"""
SELECT {_money("CASE WHEN coalesce(invoice_date, created_at) >= TIMESTAMP '2001-08-01' AND "
 "coalesce(invoice_date, created_at) < TIMESTAMP '2001-09-01' THEN invoice_amount ELSE 0 END")}
  AS revenue_this_month,
 {_money("CASE WHEN year(coalesce(invoice_date, created_at)) = 2001 THEN invoice_amount ELSE 0 END")}
  AS revenue_this_year
FROM t_orders WHERE status = 'Paid'""")
def _(spark, d):
    return plain(reports.revenue_current(X.orders(spark, d), AS_OF))


def _spine(months: int = 12) -> str:
    return (
        "SELECT strftime(CAST(m AS DATE), '%Y-%m') AS month FROM "
        f"generate_series(TIMESTAMP '2001-08-01' - INTERVAL {months - 1} MONTH, "
        "TIMESTAMP '2001-08-01', INTERVAL 1 MONTH) AS g(m)"
    )


_MONTHLY_REVENUE = f"""
SELECT s.month, CAST(coalesce(r.revenue, 0) AS DOUBLE) AS revenue FROM ({_spine()}) s
LEFT JOIN (SELECT strftime(coalesce(invoice_date, created_at), '%Y-%m') AS month,
 sum(invoice_amount) AS revenue FROM t_orders WHERE status = 'Paid' GROUP BY 1) r ON r.month = s.month"""
_MONTHLY_SHIPMENTS = f"""
SELECT s.month, coalesce(r.n, 0) AS shipments FROM ({_spine()}) s
LEFT JOIN (SELECT strftime(date_received, '%Y-%m') AS month, count(*) AS n FROM t_items GROUP BY 1) r
 ON r.month = s.month"""
_TOP = """
SELECT customer_id, coalesce(c.name, 'Unknown') AS name, CAST(revenue AS DOUBLE) AS revenue, orders
FROM (SELECT customer_id, sum(invoice_amount) AS revenue, count(*) AS orders FROM """ + STRAY_SQL + """ stray
 WHERE status = 'Paid' AND {RANGE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) t
LEFT JOIN t_customers c ON c.id = t.customer_id"""


@query("d3_monthly_revenue", _MONTHLY_REVENUE)
def _(spark, d):
    return plain(reports.monthly_revenue(X.orders(spark, d), AS_OF))


@query("d4_monthly_shipments", _MONTHLY_SHIPMENTS)
def _(spark, d):
    return plain(reports.monthly_shipments(X.items(spark, d), AS_OF))


def _stray(spark, d):
    return stray_orders(X.orders(spark, d))


@query("d5_top_customers", _TOP)
def _(spark, d):
    return plain(reports.top_customers(_stray(spark, d), X.customers(spark, d), FROM, TO))


@query("d6_customer_analytics", f"""
SELECT coalesce(c.id, o.customer_id) AS customer_id, coalesce(c.name, 'Unknown') AS name,
 coalesce(o.n, 0) AS total_orders, CAST(coalesce(o.paid, 0) AS DOUBLE) AS total_revenue,
 CAST(coalesce(o.due, 0) AS DOUBLE) AS outstanding_balance
FROM t_customers c FULL OUTER JOIN (
 SELECT customer_id, count(*) AS n, sum({_PAID}) AS paid,
  sum(CASE WHEN status IN ('Pending', 'Partial') THEN invoice_amount ELSE 0 END) AS due
 FROM {STRAY_SQL} stray WHERE {{RANGE}} GROUP BY customer_id) o ON o.customer_id = c.id""")
def _(spark, d):
    return plain(reports.customer_analytics(_stray(spark, d), X.customers(spark, d), FROM, TO))


@query("d7_total_shipments", "SELECT count(*) AS total_shipments FROM t_items")
def _(spark, d):
    return reports.total_shipments(X.items(spark, d))


@query("d8_admin_counters", f"""
SELECT (SELECT count(*) FROM t_customers) AS total_customers,
 (SELECT count(*) FROM t_customers WHERE status = 'active') AS active_customers,
 (SELECT count(*) FROM t_items WHERE status = 'Arrived at Transit Warehouse') AS items_in_warehouse,
 (SELECT count(*) FROM t_items WHERE status = 'Sorting') AS items_in_sorting,
 (SELECT count(*) FROM t_items WHERE status = 'Ready for Pickup') AS ready_for_pickup,
 (SELECT count(*) FROM t_items WHERE is_missing) AS lost_items,
 (SELECT count(*) FROM v_containers WHERE status = 'Shipped to Ghana') AS containers_in_transit,
 (SELECT {_money(_PAID)} FROM t_orders) AS total_revenue,
 (SELECT {_money("invoice_amount")} FROM t_orders WHERE status = 'Pending') AS pending_revenue""")
def _(spark, d):
    return plain(reports.admin_counters(
        X.customers(spark, d), X.items(spark, d), X.containers(spark, d), X.orders(spark, d)))


@query("d9_items_by_status", "SELECT status, count(*) AS n FROM t_items GROUP BY status")
def _(spark, d):
    return reports.items_by_status(X.items(spark, d))


@query("d10_total_cbm", "SELECT R4(sum(cbm_unit)) AS total_cbm FROM t_items")
def _(spark, d):
    return plain(reports.total_cbm(X.items(spark, d)), round_to=4)


@query("d11_orders_this_month", """
SELECT count(*) AS orders_this_month FROM t_orders
WHERE coalesce(invoice_date, created_at) >= TIMESTAMP '1998-05-01'
 AND coalesce(invoice_date, created_at) < TIMESTAMP '1998-06-01'""")
def _(spark, d):
    return reports.orders_this_month(X.orders(spark, d), "1998-05-17")


@query("d12_container_cbm", """
SELECT c.id AS container_id, c.container_ref, R4(coalesce(sum(i.cbm_unit), 0)) AS total_cbm
FROM v_containers c LEFT JOIN t_items i ON i.container_id = c.id GROUP BY 1, 2""")
def _(spark, d):
    return plain(reports.container_cbm(X.containers(spark, d), X.items(spark, d)), round_to=4)


@query("d13_container_item_count", """
SELECT c.id AS container_id, c.container_ref, count(i.id) AS item_count
FROM v_containers c LEFT JOIN t_items i ON i.container_id = c.id GROUP BY 1, 2""")
def _(spark, d):
    return reports.container_item_count(X.containers(spark, d), X.items(spark, d))


@query("d14_customer_dashboard", """
SELECT c.id AS customer_id, c.name, coalesce(i.n, 0) AS total_items, coalesce(o.n, 0) AS total_orders,
 CAST(coalesce(o.pending, 0) AS DOUBLE) AS pending_payment, R4(coalesce(i.cbm, 0)) AS total_cbm
FROM t_customers c
LEFT JOIN (SELECT customer_id, count(*) AS n, sum(cbm_unit) AS cbm FROM t_items GROUP BY 1) i
 ON i.customer_id = c.id
LEFT JOIN (SELECT customer_id, count(*) AS n,
 sum(CASE WHEN status = 'Pending' THEN invoice_amount ELSE 0 END) AS pending FROM t_orders GROUP BY 1) o
 ON o.customer_id = c.id""")
def _(spark, d):
    df = reports.customer_dashboard(X.customers(spark, d), X.items(spark, d), X.orders(spark, d))
    return plain(df, round_to=4)


@query("d15_customer_cards", """
WITH latest AS (SELECT * FROM (
 SELECT *, row_number() OVER (PARTITION BY customer_id, tracking_number ORDER BY date_received DESC, id)
  AS rn FROM t_items) q WHERE rn = 1 OR tracking_number IS NULL),
goods AS (SELECT customer_id, count(*) AS items,
 count(*) FILTER (WHERE status = 'Ready for Pickup') AS ready, R4(sum(cbm_unit)) AS cbm,
 count(*) FILTER (WHERE status <> 'Completed') AS active,
 count(*) FILTER (WHERE status IN ('Shipped to Ghana', 'Arrived in Ghana')) AS in_transit,
 count(*) FILTER (WHERE status IN ('Completed', 'Ready for Pickup')) AS delivered
 FROM latest WHERE date_received >= {AS_OF} - INTERVAL 1 YEAR AND date_received <= {AS_OF} GROUP BY 1),
bills AS (SELECT customer_id, count(*) AS orders,
 sum(CASE WHEN status IN ('Pending', 'Partial') THEN invoice_amount ELSE 0 END) AS unpaid
 FROM t_orders WHERE invoice_date >= {AS_OF} - INTERVAL 1 YEAR AND invoice_date <= {AS_OF} GROUP BY 1)
SELECT coalesce(g.customer_id, b.customer_id) AS customer_id, coalesce(items, 0) AS items,
 coalesce(ready, 0) AS ready, coalesce(cbm, 0) AS cbm, coalesce(active, 0) AS active,
 coalesce(in_transit, 0) AS in_transit, coalesce(delivered, 0) AS delivered,
 coalesce(orders, 0) AS orders, CAST(coalesce(unpaid, 0) AS DOUBLE) AS unpaid
FROM goods g FULL OUTER JOIN bills b ON b.customer_id = g.customer_id""")
def _(spark, d):
    df = reports.customer_cards(X.items(spark, d), X.orders(spark, d), "year", AS_OF)
    return plain(df, round_to=4)


@query("d16_customer_status_counts", """
SELECT customer_id, status, count(*) AS n FROM t_items GROUP BY 1, 2""")
def _(spark, d):
    return reports.customer_status_counts(X.items(spark, d))


@query("d17_sorting_counts", """
SELECT count(*) FILTER (WHERE status = 'Sorting') AS sorting_count,
 count(*) FILTER (WHERE is_missing) AS missing_count FROM t_items""")
def _(spark, d):
    return reports.sorting_counts(X.items(spark, d))


@query("d18_sorting_by_container", """
SELECT CAST(i.container_id AS VARCHAR) AS container_id,
 coalesce(c.name, CAST(i.container_id AS VARCHAR), 'No Container') AS container_name, count(*) AS n
FROM t_items i LEFT JOIN v_containers c ON c.id = i.container_id
WHERE i.status = 'Sorting' GROUP BY 1, 2""")
def _(spark, d):
    df = reports.sorting_by_container(X.items(spark, d), X.containers(spark, d))
    return plain(df, text=("container_id",))


@query("d19_collection_rate", """
SELECT CAST(floor(count(*) FILTER (WHERE status = 'Paid') / CAST(count(*) AS DOUBLE) * 100 + 0.5e0)
 AS BIGINT) AS collection_rate FROM t_orders WHERE {RANGE}""")
def _(spark, d):
    return reports.collection_rate(X.orders(spark, d), FROM, TO)


@query("d20_order_cbm", """
SELECT o.id AS order_id, R4(coalesce(sum(i.cbm_total), 0)) AS total_cbm
FROM t_orders o LEFT JOIN t_items i ON i.order_id = o.id GROUP BY 1""")
def _(spark, d):
    return plain(reports.order_cbm(X.orders(spark, d), X.items(spark, d)), round_to=4)


@query("d21_invoice_value", """
SELECT customer_id, R2(CAST(sum(coalesce(pkg, est, 0)) AS DOUBLE)) AS invoice_value FROM (
 SELECT customer_id, CASE WHEN quantity % 2 = 0 THEN CAST(weight * 3 AS DECIMAL(18,2)) END AS pkg,
  CASE WHEN quantity % 3 = 0 THEN CAST(weight * 5 AS DECIMAL(18,2)) END AS est FROM t_items) q
GROUP BY 1""")
def _(spark, d):
    q, w = F.col("quantity"), F.col("weight")
    items = X.items(spark, d).withColumns({
        "pkg_est_shipping": F.when(q % 2 == 0, (w * 3).cast("decimal(18,2)")),
        "est_shipping_price": F.when(q % 3 == 0, (w * 5).cast("decimal(18,2)")),
    })
    return plain(reports.invoice_value(items, "customer_id"))


@query("e4_ranked_customers", f"""
SELECT *, CAST(row_number() OVER (ORDER BY revenue DESC, customer_id) AS INTEGER) AS rank,
 R4(revenue / max(revenue) OVER () * 100) AS pct_of_leader FROM ({_TOP}) t""")
def _(spark, d):
    top = reports.top_customers(_stray(spark, d), X.customers(spark, d), FROM, TO)
    return plain(windows.ranked_customers(top), round_to=4)


@query("e5_share_of_max", f"""
SELECT month, shipments, R4(greatest(shipments / greatest(CAST(max(shipments) OVER () AS DOUBLE), 1e0) * 100,
 CASE WHEN shipments > 0 THEN 4e0 ELSE 0e0 END)) AS pct_of_peak FROM ({_MONTHLY_SHIPMENTS}) t""")
def _(spark, d):
    monthly = reports.monthly_shipments(X.items(spark, d), AS_OF)
    return plain(windows.share_of_max(monthly, "shipments"), round_to=4)
