"""SQL text of the raw (``v_``) and loaded (``t_``) tables used by the query oracles."""

_CUSTOMER_MAIL = "concat(lower(replace(c_name, '#', '.')), '@example.com')"
_PLAIN_NUMBER = (
    "CAST(240000000 + c_custkey - CASE WHEN c_custkey % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR)"
)


def _initial(word: str) -> str:
    letters = f"regexp_replace(coalesce({word}, ''), '[^A-Za-z]', '', 'g')"
    return f"coalesce(nullif(upper(left({letters}, 1)), ''), 'X')"


def mark_sql(name: str, phone: str, prefix: str) -> str:
    words = f"string_split_regex(trim({name}), '\\s+')"
    return (
        f"concat('{prefix}', {_initial(words + '[1]')}, {_initial(words + '[2]')}, "
        f"right(regexp_replace({phone}, '[^0-9]', '', 'g'), 4))"
    )


def e164_sql(phone: str) -> str:
    d = f"regexp_replace({phone}, '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN {d} LIKE '233%' AND length({d}) >= 12 THEN concat('+', {d}) "
        f"WHEN {d} LIKE '0%' AND length({d}) = 10 THEN concat('+233', substr({d}, 2)) "
        f"WHEN length({d}) >= 10 THEN concat('+', {d}) END"
    )


def step_sql(status: str) -> str:
    return (
        f"CASE {status} WHEN 'Arrived at Transit Warehouse' THEN 0 WHEN 'Shipped to Ghana' THEN 1 "
        "WHEN 'Arrived in Ghana' THEN 2 WHEN 'Sorting' THEN 3 WHEN 'Ready for Pickup' THEN 4 "
        "WHEN 'Completed' THEN 5 ELSE -1 END"
    )


VIEWS = {
    "v_customers": f"""
SELECT c_custkey AS id, c_name AS name,
 CASE c_custkey % 3 WHEN 0 THEN concat('0', {_PLAIN_NUMBER})
  WHEN 1 THEN concat('+233 ', {_PLAIN_NUMBER}) ELSE concat('233', {_PLAIN_NUMBER}) END AS phone,
 {_CUSTOMER_MAIL} AS email,
 CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status,
 CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'standard' WHEN 'FURNITURE' THEN 'business'
  WHEN 'MACHINERY' THEN 'premium' WHEN 'AUTOMOBILE' THEN 'special' ELSE NULL END AS package_raw,
 CASE WHEN c_custkey % 4 = 0 THEN 'air' ELSE 'sea' END AS shipping_type,
 DATE '1995-01-01' + CAST(c_custkey % 2400 AS INT) AS created_at
FROM customer""",
    "v_containers": """
SELECT s_suppkey AS id, concat('CON-', CAST(s_suppkey AS VARCHAR)) AS container_ref, s_name AS name,
 CASE s_nationkey % 3 WHEN 0 THEN 'Loading' WHEN 1 THEN 'Shipped to Ghana'
  ELSE 'Arrived in Ghana' END AS status,
 CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE DATE '2001-06-01' + CAST(s_suppkey % 90 AS INT) END AS eta
FROM supplier""",
    "v_orders": """
SELECT o_orderkey AS id, o_custkey AS customer_id,
 CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' ELSE 'Partial' END AS status,
 CAST(o_totalprice AS DECIMAL(18,2)) AS invoice_amount,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS invoice_date,
 o_orderdate AS created_at,
 CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(100 AS DECIMAL(18,2)) ELSE NULL END AS discount
FROM orders""",
    "v_items": """
SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_partkey AS VARCHAR), '-',
  CAST(l_suppkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-',
  CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS id,
 o_custkey AS customer_id,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS order_id,
 CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_suppkey END AS container_id,
 CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Arrived at Transit Warehouse'
  WHEN 'AO' THEN 'Shipped to Ghana' WHEN 'NF' THEN 'Arrived in Ghana' WHEN 'NO' THEN 'Sorting'
  WHEN 'RF' THEN 'Ready for Pickup' ELSE 'Completed' END AS status,
 l_tax = 0.08 AS is_missing,
 CASE WHEN l_linenumber % 4 = 0 THEN 'air' ELSE 'sea' END AS shipping_type,
 CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS length,
 CAST(10 + p_size % 7 AS DOUBLE) AS width, CAST(20 AS DOUBLE) AS height,
 CASE WHEN p_size % 2 = 0 THEN 'inches' ELSE 'cm' END AS dimension_unit,
 CAST(p_size AS DOUBLE) / 4 AS weight, CAST(l_quantity AS INT) AS quantity,
 p_name AS description,
 CASE WHEN l_linenumber = 3 THEN NULL ELSE concat('TRK', CAST(l_partkey AS VARCHAR)) END
  AS tracking_number,
 l_shipdate AS date_received, p_type AS part_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "v_history": """
SELECT event_id AS id, user_id AS record_id,
 CASE event_type WHEN 'signup' THEN 'Arrived at Transit Warehouse' WHEN 'view' THEN 'Shipped to Ghana'
  WHEN 'click' THEN 'Arrived in Ghana' WHEN 'error' THEN 'Sorting'
  ELSE 'Ready for Pickup' END AS new_status,
 ts AS changed_at, value AS amount
FROM events""",
    "v_suppliers": """
SELECT s_suppkey AS id, s_name AS name,
 CASE s_nationkey % 4 WHEN 0 THEN 'Electronics' WHEN 1 THEN 'Clothing' WHEN 2 THEN 'Toys'
  ELSE 'Other' END AS category,
 CASE s_nationkey % 3 WHEN 0 THEN 'Alibaba' WHEN 1 THEN 'Taobao' ELSE 'Other' END AS platform,
 CAST(1 + s_suppkey % 5 AS INT) AS rating
FROM supplier""",
    "v_payments": """
SELECT o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
 CAST(CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 500 ELSE o_totalprice END AS DECIMAL(18,2))
  AS amount_paid
FROM orders WHERE o_orderstatus <> 'F'""",
    "v_rates": """
SELECT tier, CAST(200 + n % 250 AS DOUBLE) AS sea, CAST(5 + n % 7 AS DOUBLE) AS air
FROM (SELECT coalesce(package, 'gold') AS tier, count(*) AS n FROM t_customers GROUP BY 1) q
WHERE tier <> 'basic'""",
    "v_special_rates": """
SELECT name, CAST(100 + n % 50 AS DOUBLE) AS sea, CAST(2 + n % 5 AS DOUBLE) AS air
FROM (SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1) q""",
    "v_users": f"""
SELECT concat('U', CAST(c_custkey AS VARCHAR)) AS id,
 concat('uid-', CAST(c_custkey AS VARCHAR)) AS login_uid, {_CUSTOMER_MAIL} AS email,
 CASE WHEN c_custkey % 50 = 0 THEN 'super_admin' WHEN c_custkey % 20 = 0 THEN 'warehouse_staff'
  END AS role,
 CASE WHEN c_custkey % 50 <> 0 AND c_custkey % 20 <> 0 THEN c_custkey END AS customer_id,
 CASE WHEN c_custkey % 4 = 0 THEN c_name END AS customer_name,
 DATE '2000-01-01' + CAST(c_custkey % 365 AS INT) AS last_login
FROM customer""",
    "v_warehouses": """
SELECT n_nationkey AS id, n_name AS name, concat('Dock ', CAST(n_regionkey AS VARCHAR)) AS address,
 CASE n_nationkey % 4 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS is_active,
 DATE '2000-12-31' - n_nationkey AS created_at
FROM nation""",
    "v_registrations": f"""
SELECT c_custkey + 1000000 AS id, c_name AS name,
 concat('0', CAST(240000000 + c_custkey AS VARCHAR)) AS phone,
 CASE WHEN c_custkey % 2 = 0 THEN {_CUSTOMER_MAIL}
  ELSE concat('new', CAST(c_custkey AS VARCHAR), '@example.com') END AS email,
 CASE c_custkey % 3 WHEN 0 THEN 'Created' WHEN 1 THEN 'Review' END AS status,
 DATE '2001-01-01' + CAST(c_custkey % 200 AS INT) AS submitted_at
FROM customer""",
    "v_logs": """
SELECT o_orderkey AS id, o_orderpriority AS action,
 CASE WHEN o_orderkey % 5 <> 0
  THEN concat('staff', CAST(o_orderkey % 7 AS VARCHAR), '@example.com') END AS user_email,
 CASE o_orderkey % 4 WHEN 0 THEN 'Signed in'
  WHEN 1 THEN concat('Invoice for CUS', CAST(o_custkey AS VARCHAR), ' sent')
  WHEN 2 THEN concat('Moved BOX', CAST(o_orderkey % 150 AS VARCHAR), ' of CUS',
   CAST(o_custkey AS VARCHAR), ', again CUS', CAST(o_custkey AS VARCHAR))
  ELSE concat('Checked BOX', CAST(o_orderkey % 150 AS VARCHAR)) END AS details,
 o_orderdate AS timestamp
FROM orders""",
    "t_customers": f"""
SELECT id, name, phone, email, '' AS shipping_address,
 {mark_sql('name', 'phone', 'FRT-')} AS shipping_mark, coalesce(status, 'active') AS status,
 shipping_type,
 CASE package_raw WHEN 'standard' THEN 'basic' WHEN 'discounted' THEN 'business'
  WHEN 'premium' THEN 'enterprise' ELSE package_raw END AS package,
 CAST(created_at AS TIMESTAMP) AS created_at
FROM v_customers""",
    "t_items": f"""
SELECT id, id AS item_ref, customer_id, order_id, container_id, status,
 coalesce(is_missing, FALSE) AS is_missing, shipping_type, length, width, height,
 coalesce(dimension_unit, 'cm') AS dimension_unit, nullif(weight, 0) AS weight, quantity,
 coalesce(description, '') AS description, tracking_number, date_received, part_type,
 {{CBM}} AS cbm_unit, {{CBMQ}} AS cbm_total, {step_sql('status')} AS step_no
FROM v_items""",
    "t_orders": """
SELECT id, CAST(id AS VARCHAR) AS order_ref, customer_id, status, invoice_amount, discount,
 invoice_date, created_at
FROM v_orders""",
    "t_containers": "SELECT *, CAST(eta AS TIMESTAMP) AS eta_at FROM v_containers",
    "t_rates": """
SELECT d.tier, coalesce(r.sea, d.sea) AS sea, coalesce(r.air, d.air) AS air
FROM (VALUES ('basic', 350e0, 8e0), ('business', 280e0, 6e0), ('enterprise', 450e0, 12e0),
 ('special', 500e0, 15e0)) AS d(tier, sea, air)
LEFT JOIN v_rates r ON r.tier = d.tier""",
    "t_steps": """
SELECT * FROM (VALUES (0, 'Arrived at Transit Warehouse'), (1, 'Shipped to Ghana'),
 (2, 'Arrived in Ghana'), (3, 'Sorting'), (4, 'Ready for Pickup'), (5, 'Completed'))
 AS s(step_no, step)""",
    "t_item_history": """
SELECT concat(i.id, '/', CAST(s.step_no AS VARCHAR)) AS id, i.id AS record_id, s.step AS new_status,
 CAST(i.date_received AS DATE) + CAST(s.step_no * 9 AS INT) AS changed_at
FROM t_items i JOIN t_steps s ON s.step_no <= i.step_no
WHERE (i.quantity + s.step_no) % 3 <> 0""",
    "t_users": """
SELECT id, login_uid, email, coalesce(role, 'customer') AS role, customer_id, customer_name,
 last_login FROM v_users""",
    "t_warehouses": """
SELECT id, name, address, coalesce(is_active, TRUE) AS is_active, created_at FROM v_warehouses""",
    "t_registrations": """
SELECT id, name, phone, email,
 CASE WHEN status = 'Created' THEN 'Created' ELSE 'Pending' END AS status, submitted_at
FROM v_registrations""",
    "t_status_requests": """
SELECT concat('R', id) AS request_id, id AS item_id,
 (SELECT step FROM t_steps s WHERE s.step_no = (i.step_no + quantity) % 6) AS new_status,
 CASE WHEN quantity % 2 = 0 THEN 'warehouse_staff' ELSE 'super_admin' END AS role,
 CASE WHEN quantity % 3 = 0 THEN 'desk' ELSE 'ops@example.com' END AS actor,
 date_received + INTERVAL 100 DAY AS requested_at
FROM t_items i WHERE quantity % 5 <> 0
UNION ALL
SELECT concat('P', id), id, (SELECT step FROM t_steps s WHERE s.step_no = (i.step_no + 1) % 6), 'warehouse_staff',
 CASE WHEN quantity % 3 = 0 THEN 'desk' ELSE 'ops@example.com' END, date_received + INTERVAL 75 DAY
FROM t_items i WHERE quantity % 4 <> 0
UNION ALL
SELECT concat('S', id), id, (SELECT step FROM t_steps s WHERE s.step_no = (i.step_no + quantity + 3) % 6),
 CASE WHEN quantity % 2 = 0 THEN 'warehouse_staff' ELSE 'super_admin' END,
 CASE WHEN quantity % 3 = 0 THEN 'desk' ELSE 'ops@example.com' END, date_received + INTERVAL 125 DAY
FROM t_items i WHERE quantity % 3 = 1
UNION ALL
SELECT concat('Q', id), id, 'Completed', 'super_admin', 'ops@example.com',
 date_received + INTERVAL 50 DAY
FROM t_items WHERE quantity % 7 = 0
UNION ALL
SELECT concat('X', id), concat(id, '?'), 'Completed', 'super_admin', 'ops@example.com', date_received
FROM t_items WHERE quantity % 11 = 0""",
    "t_loads": """
SELECT concat('A', id) AS request_id, id AS item_id,
 (quantity * 7) % ((SELECT count(*) FROM v_containers) + 2) AS container_id,
 date_received AS requested_at
FROM t_items WHERE quantity % 2 = 0
UNION ALL
SELECT concat('B', id), id, coalesce(container_id, 3), date_received + INTERVAL 1 DAY
FROM t_items WHERE quantity % 3 = 0
UNION ALL
SELECT concat('X', id), concat(id, '?'), 1, date_received FROM t_items WHERE quantity % 11 = 0""",
    "t_actions": """
SELECT concat('R', id) AS request_id, id AS item_id,
 CASE quantity % 3 WHEN 0 THEN 'found' WHEN 1 THEN 'missing' ELSE 'lost' END AS action,
 date_received + INTERVAL 100 DAY AS requested_at
FROM t_items WHERE status = 'Sorting' OR is_missing
UNION ALL
SELECT concat('Q', id), id, 'missing', date_received + INTERVAL 50 DAY
FROM t_items WHERE quantity % 7 = 0""",
    "t_box_requests": """
SELECT concat('C', CAST(id AS VARCHAR)) AS request_id, id AS container_id,
 CASE id % 3 WHEN 0 THEN 'Shipped to Ghana' WHEN 1 THEN 'Arrived in Ghana' ELSE 'Loading' END
  AS new_status,
 CASE WHEN id % 2 = 0 THEN DATE '2001-07-01' + CAST(id % 30 AS INT) END AS arrival_date,
 DATE '2001-07-02' AS requested_at
FROM v_containers WHERE id % 4 <> 3
UNION ALL SELECT concat('D', CAST(id AS VARCHAR)), id, 'Loading', NULL, DATE '2001-07-03'
FROM v_containers WHERE id % 5 < 2
UNION ALL SELECT concat('B', CAST(id AS VARCHAR)), id, 'Shipped to Ghana', DATE '2001-07-01' + CAST(id % 30 AS INT),
 DATE '2001-07-01' FROM v_containers WHERE id % 3 = 1
UNION ALL SELECT concat('X', CAST(id AS VARCHAR)), -id - 1, 'Loading', NULL, DATE '2001-07-02'
FROM v_containers WHERE id % 7 = 0""",
    "t_sold": """
SELECT *, CASE WHEN id % 2 = 0 THEN concat('S', CAST(id AS VARCHAR)) END AS sale_id,
 CASE WHEN id % 4 = 0 THEN CAST(50 AS DECIMAL(18,2)) END AS amount_paid,
 CASE WHEN id % 4 = 0 THEN invoice_amount - 50 END AS balance_due
FROM t_orders""",
    "t_snapshots": """
SELECT concat('S', CAST(order_id AS VARCHAR)) AS sale_id,
 CASE WHEN order_id % 10 <> 0 THEN CAST(total_amount AS DOUBLE) END AS total_amount,
 CASE WHEN order_id % 10 <> 0 THEN CAST(amount_paid AS DOUBLE) END AS sale_paid,
 CASE WHEN order_id % 10 <> 0 THEN CAST(total_amount - amount_paid AS DOUBLE) END AS sale_balance
FROM v_payments WHERE order_id % 2 = 0""",
}
