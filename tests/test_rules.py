"""Column rules on hand-made values."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cargoframe.functions import measures as M, statuses, text as X, times
from cargoframe.operators import filters, links, listing, pricing, quality, reports, windows
from cargoframe.sources import loads
from tests.conftest import rows, same

BOX = "length double, width double, height double, dimension_unit string, quantity int"


def one(spark, column, ddl="x int", row=(1,)):
    return spark.createDataFrame([row], ddl).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("value, expected", [(1.005, 1.0), (1.015, 1.01), (2.5, 2.5), (-1.255, -1.25), (0.125, 0.13)])
def test_rounding_is_floor_of_half_up(spark, value, expected):
    # 1.005 * 100 is 100.49999... in doubles, so the reference rule gives 1.0 there
    assert one(spark, M.round_half_up(F.lit(value))) == expected


def test_volume_rules(spark):
    cases = [
        (100.0, 50.0, 20.0, "cm", 3, 0.1, 0.3),
        (10.0, 10.0, 10.0, "inches", 2, 0.016387064, 0.032774128),
        (0.0, 50.0, 20.0, "cm", 3, 0.0, 0.0),
        (None, 50.0, 20.0, "cm", 3, 0.0, 0.0),
        (100.0, 50.0, 20.0, None, None, 0.1, 0.1),
    ]
    df = spark.createDataFrame([c[:5] for c in cases], BOX)
    got = df.select(M.cbm_unit(), M.cbm_total()).collect()
    for (unit, total), case in zip(got, cases):
        assert (unit, total) == pytest.approx(case[5:])


def test_cube_side(spark):
    assert one(spark, M.cube_side(F.lit(0.125))) == 50.0
    assert one(spark, M.cube_side(F.lit(0.0))) is None


@pytest.mark.parametrize("rate, expected", [(12.5, 125.0), (0.0, 10.0), (-1.0, 10.0), (None, 10.0)])
def test_missing_rate_counts_as_one(spark, rate, expected):
    assert one(spark, M.to_local(F.lit(10.0), F.lit(rate).cast("double"))) == expected


@pytest.mark.parametrize("base, value, mode, expected", [
    (200.0, 15.0, "pct", 30.0), (200.0, 15.0, "fixed", 15.0), (0.0, 15.0, "pct", 0.0),
    (200.0, None, "pct", 0.0), (33.33, 33.0, "pct", 11.0),
])
def test_discount(spark, base, value, mode, expected):
    column = M.discount_amount(F.lit(base), F.lit(value).cast("double"), F.lit(mode))
    assert one(spark, column) == expected


@pytest.mark.parametrize("phone, e164, chat", [
    ("+233 24-000-0001", "+233240000001", "+233240000001"),
    ("00233240000001", "+00233240000001", "+00233240000001"),
    ("0240000001", "+233240000001", "+233240000001"),
    ("2402400001", "+2402400001", "2402400001"),
    ("12345", None, "12345"),
])
def test_phone_forms(spark, phone, e164, chat):
    assert one(spark, X.phone_e164(F.lit(phone))) == e164
    assert one(spark, X.phone_chat(F.lit(phone))) == chat


@pytest.mark.parametrize("name, phone, mark", [
    ("Ama Mensah", "+233 24 123 4567", "P-AM4567"), ("ama", "12", "P-AX12"),
    ("  Kofi   boateng Jr", "0201112222", "P-KB2222"), ("Ñandú 3x", "555", "P-AX555"), ("", "", "P-XX"),
    ("李 小龙", "9999", "P-XX9999"),
])
def test_shipping_mark(spark, name, phone, mark):
    assert one(spark, X.shipping_mark(F.lit(name), F.lit(phone), "P-")) == mark


def test_padding_never_cuts(spark):
    assert one(spark, X.reference("ITM-", F.lit(7), 4)) == "ITM-0007"
    assert one(spark, X.reference("ITM-", F.lit(123456), 4)) == "ITM-123456"


def test_line_label_is_printable_and_limited(spark):
    ddl = "description string, item_ref string, tracking_number string, " + BOX
    df = spark.createDataFrame([
        ("Café ☕ set", "ITM-1", "T1", 100.0, 50.0, 20.0, "cm", 3),
        ("", "ITM-2", None, None, 1.0, 1.0, "cm", 1), ("x" * 300, "ITM-3", "T3", 1.0, 1.0, 1.0, "cm", 1),
    ], ddl)
    labels = [r[0] for r in df.select(X.line_label()).collect()]
    assert labels[0] == "Caf  set [TRK: T1] [CBM: 0.3000m3]"
    assert labels[1] == "ITM-2"
    assert labels[2] == "x" * 200
    first = [r[0] for r in df.select(X.first_line_label()).collect()]
    assert first[0] == "Freight: Caf  set [TRK: T1] [CBM: 0.3000 m3]"
    assert first[1] == "Freight Item (ITM-2)"


def test_status_step(spark):
    assert one(spark, statuses.step_index(F.lit("Sorting"))) == 3
    assert one(spark, statuses.step_index(F.lit("nowhere"))) == -1


@pytest.mark.parametrize("payload, expected", [
    ('{"total_amount": "100", "amount_paid": 40}', (100.0, 40.0, 60.0)),
    ('{"data": {"grand_total": 80, "paid": "x", "remaining": "5"}}', (80.0, 0.0, 5.0)),
    ('{"amount": 0, "paid": 3}', (None, 3.0, 0.0)),
    ("not json", (None, 0.0, 0.0)),
])
def test_sale_amounts(spark, payload, expected):
    df = spark.createDataFrame([(payload,)], "p string")
    assert tuple(df.select(*statuses.sale_amounts(F.col("p"))).first()) == expected


def test_blank_and_broken_dates_become_null(spark):
    df = spark.createDataFrame([("",), ("nonsense",), ("2024-02-29",), ("2024-02-29T10:00:00",)], "t string")
    got = [r[0] for r in df.select(times.time_column(df, "t")).collect()]
    assert got == [None, None, dt.datetime(2024, 2, 29), dt.datetime(2024, 2, 29, 10)]


def test_periods_clamp_and_include_last_day(spark):
    df = spark.createDataFrame(
        [(1, "2024-02-29 00:00:00"), (2, "2024-02-28 23:59:59"), (3, "2024-03-31 12:00:00"),
         (4, "2024-03-31 23:59:59"), (5, None)], "id int, t string",
    ).withColumn("t", F.col("t").cast("timestamp_ntz"))
    month = filters.period_filter(df, "t", "month", "2024-03-31 12:00:00")
    assert rows(month, "id") == [(3,)] and not rows(month.filter("id = 1"), "id")
    early = filters.period_filter(df, "t", "month", "2024-03-29 00:00:00")
    assert rows(early, "id") == [(1,)]
    custom = filters.period_filter(df, "t", "custom", None, "2024-03-31", "2024-03-31")
    assert rows(custom, "id") == [(3,), (4,)]
    assert filters.period_filter(df, "t", "custom").count() == 5
    assert filters.period_filter(df, "t", "all").count() == 5
    assert rows(filters.period_filter(df, "t", "today", "2024-03-31 12:00:00"), "id") == [(3,)]


def test_search_is_literal(spark):
    df = spark.createDataFrame([(1, "50% off"), (2, "50 off"), (3, None)], "id int, a string")
    assert rows(filters.search_any(df, ("a",), "0%"), "id") == [(1,)]
    assert filters.search_any(df, ("a",), "").count() == 3


def test_customer_analytics_keeps_unknown_and_empty(spark):
    orders = spark.createDataFrame(
        [(1, "a", "Paid", 10.0), (2, "a", "Partial", 5.0), (3, "zz", "Pending", 7.0), (4, None, "Paid", 9.0)],
        "id int, customer_id string, status string, amount double",
    ).select("id", "customer_id", "status", F.col("amount").cast("decimal(18,2)").alias("invoice_amount"),
             F.lit("2024-01-01").cast("timestamp_ntz").alias("invoice_date"),
             F.lit(None).cast("timestamp_ntz").alias("created_at"))
    people = spark.createDataFrame([("a", "Ama"), ("b", "Ben")], "id string, name string")
    got = rows(reports.customer_analytics(orders, people))
    assert [(r[0], r[1], r[2], float(r[3]), float(r[4])) for r in got] == [
        ("a", "Ama", 2, 10.0, 5.0), ("b", "Ben", 0, 0.0, 0.0), ("zz", "Unknown", 1, 0.0, 7.0)]
    totals = reports.revenue_totals(orders).first()
    assert (float(totals["total_revenue"]), float(totals["pending_revenue"])) == (19.0, 7.0)
    assert reports.collection_rate(orders.filter("id > 99")).first()[0] is None
    assert reports.revenue_totals(orders.filter("id > 99")).first()["avg_order_value"] == 0.0


def test_monthly_reports_have_every_month(spark):
    items = spark.createDataFrame([("2023-12-31",), ("2024-01-01",), ("2024-01-31",)], "d string").select(
        F.col("d").cast("timestamp_ntz").alias("date_received"))
    got = {r["month"]: r["shipments"] for r in reports.monthly_shipments(items, "2024-01-31").collect()}
    assert len(got) == 12 and got["2024-01"] == 2 and got["2023-12"] == 1 and got["2023-02"] == 0


def test_legacy_tiers_and_defaults(spark):
    raw = spark.createDataFrame([(1, "premium", None), (2, "gold", "inactive"), (3, None, None)],
                                "id int, package string, status string")
    got = rows(loads.load_customers(raw), "id", "package", "status", "name")
    assert got == [(1, "enterprise", "active", ""), (2, "gold", "inactive", ""), (3, None, "active", "")]
    item = loads.load_items(spark.createDataFrame([("i", 0.0, ["c1", "c2"])], "id string, weight double, customer array<string>"))
    row = item.first()
    assert (row["weight"], row["customer_id"], row["dimension_unit"], row["is_missing"], row["item_ref"]) == (
        None, "c1", "cm", False, "i")


def test_settings_without_row_are_null(spark):
    empty = spark.createDataFrame([], "usd_to_local double, rate_per_cbm double")
    assert tuple(loads.load_settings(empty).first()) == (None, None)


def test_messages_are_parsed(spark):
    text = '[{"id":"m1","sender":"customer","content":"hi","timestamp":"2024-01-15T10:30:00.000Z","type":"text"},' \
           '{"id":"m2","sender":"admin","content":"","timestamp":"bad","type":"image","fileSize":7}]'
    df = loads.support_messages(spark.createDataFrame([("t", text), ("u", "broken")], "id string, messages string"))
    assert rows(df, "ticket_id", "message_id", "type", "file_size", "sent_at") == [
        ("t", "m1", "text", None, dt.datetime(2024, 1, 15, 10, 30)), ("t", "m2", "image", 7, None)]


def test_rate_card_overrides_defaults(spark):
    stored = spark.createDataFrame([("business", 1.0, 2.0), ("gold", 9.0, 9.0)], "tier string, sea double, air double")
    assert rows(links.rate_card(stored)) == [
        ("basic", 350.0, 8.0), ("business", 1.0, 2.0), ("enterprise", 450.0, 12.0), ("special", 500.0, 15.0)]


def test_longest_dial_code_wins(spark):
    people = spark.createDataFrame(
        [(1, "+12425551"), (2, "+1555"), (3, "+999 1"), (4, ""), (5, None), (6, "0240")], "id int, phone string")
    got = rows(links.phone_country(people, ("+1", "+1242", "+233")), "customer_id", "dial_code", "local_number")
    assert got == [(1, "+1242", "5551"), (2, "+1", "555"), (3, "+233", "999 1"), (4, "+233", ""),
                   (5, "+233", ""), (6, "+233", "0240")]


def test_preferred_warehouse_survives_empty_table(spark):
    people = spark.createDataFrame([(1, "m", 5), (2, "n", None)], "id int, shipping_mark string, preferred_warehouse_id int")
    houses = spark.createDataFrame([(4, "d4", "a4", 2), (5, "d5", "a5", 3), (6, "d6", "a6", 1)],
                                   "id int, name string, address string, created_at int")
    got = rows(links.preferred_warehouse(people, houses), "customer_id", "warehouse_id")
    assert got == [(1, 5), (2, 6)]
    assert links.preferred_warehouse(people, houses.filter("id > 9")).count() == 2


def test_dedupe_is_idempotent_and_keeps_blanks(spark):
    items = spark.createDataFrame(
        [("a", "T", "2024-01-01"), ("b", "T", "2024-01-02"), ("c", "T", "2024-01-02"), ("d", None, "2024-01-01"),
         ("e", None, "2024-01-01"), ("f", " ", None), ("g", "U", None)], "id string, tracking_number string, t string",
    ).withColumn("date_received", F.col("t").cast("timestamp_ntz"))
    once = windows.dedupe_tracking(items)
    assert [r[0] for r in rows(once, "id")] == ["b", "d", "e", "f", "g"]
    assert same(windows.dedupe_tracking(once), once)


def test_pages_partition_the_list(spark):
    df = spark.range(23).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    order = listing.canonical_order("customers")
    pages = [[r["id"] for r in listing.paginate(df, p, 10, order).collect()] for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [10, 10, 3, 0] and sorted(sum(pages, [])) == list(range(23))
    info = listing.page_info(df, 3, 10).first().asDict()
    assert info == {"total": 23, "total_pages": 3, "page": 3, "has_more": False, "from_row": 21, "to_row": 23}
    assert listing.page_info(df.filter("id < 0"), 1, 10).first()["total_pages"] == 1
    after = listing.page_after(df, "customers", dt.datetime(2024, 1, 1), 9, 10)
    assert [r["id"] for r in after.collect()] == pages[1]


def test_pages_at_any_depth(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int"))
    df = spark.range(3000).withColumn("created_at", F.when(F.col("id") % 7 != 0, day).cast("timestamp_ntz"))
    order = listing.canonical_order("customers")
    listed = [r["id"] for r in listing.list_sorted(df, "customers").collect()]
    for page, limit in ((1, 20), (7, 20), (43, 70), (3, 1000), (4, 1000), (2, 1600)):
        got = [r["id"] for r in listing.paginate(df, page, limit, order).collect()]
        assert got == listed[(page - 1) * limit:page * limit]
    assert [listing.page_size("customers", 600), listing.page_size("items", 600), listing.page_size("items")] == [600, 500, 50]


def test_numbering_leaves_no_files_behind(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    count = lambda: sum(len(files) for _, _, files in os.walk(folder))
    before = count()
    windows.invoice_line_no(spark.range(100).withColumn("order_id", F.lit(1)), [("id", "desc")]).collect()
    listing.paginate(spark.range(100), 5, 10, [("id", "asc")]).collect()
    assert count() == before


ITEM = ("id string, order_id string, item_ref string, description string, tracking_number string, "
        "length double, width double, height double, dimension_unit string, quantity int")


def _lines(spark, amount, discount, boxes, fx=1.0, status="Pending"):
    orders = spark.createDataFrame([("o", "ORD-1", status, amount, discount)],
                                   "id string, order_ref string, status string, a double, d double")
    orders = orders.select("id", "order_ref", "status", F.col("a").cast("decimal(18,2)").alias("invoice_amount"),
                           F.col("d").cast("decimal(18,2)").alias("discount"))
    items = spark.createDataFrame(
        [(f"i{n}", "o", f"ITM-{n}", "thing", None, box, 1.0, 1.0, "cm", None) for n, box in enumerate(boxes)], ITEM)
    settings = spark.createDataFrame([(fx,)], "usd_to_local double")
    return orders, items, settings


@pytest.mark.parametrize("amount, discount, boxes, fx, expected", [
    (100.0, None, [1.0, 1.0, 1.0], 1.0, [33.33, 33.33, 33.34]),
    (100.0, None, [0.0, 0.0, 0.0], 1.0, [33.33, 33.33, 33.34]),
    (0.01, None, [1.0, 1.0, 1.0], 1.0, [0.0, 0.0, 0.01]),
    (0.05, None, [1.0, 1.0, 1.0, 1.0], 2.0, [0.03, 0.03, 0.03, 0.01]),
    (0.02, None, [1.0] * 4, 1.0, [0.01, 0.01, 0.01, -0.01]),
    (10.0, 20.0, [1.0, 2.0], 1.0, [0.0, 0.0]),
    (10.0, 1.0, [3.0, 1.0], 12.5, [84.38, 28.12]),
    (10.0, None, [5.0], 0.0, [10.0]),
])
def test_invoice_split(spark, amount, discount, boxes, fx, expected):
    got = pricing.invoice_lines(*_lines(spark, amount, discount, boxes, fx))
    assert [float(r[1]) for r in rows(got, "item_id", "price")] == expected


def test_order_without_items_and_paid_order(spark):
    orders, items, settings = _lines(spark, 10.0, None, [])
    only = pricing.invoice_lines(orders, items, settings).collect()
    assert [(r["item_name"], float(r["price"])) for r in only] == [("Freight - ORD-1", 10.0)]
    assert pricing.invoice_lines(*_lines(spark, 10.0, None, [1.0], status="Paid")).isEmpty()


def test_quoted_prices(spark):
    orders, items, settings = _lines(spark, 100.0, None, [1.0, 1.0])
    quoted = spark.createDataFrame([("i0", 30.0), ("i1", 10.0)], "item_id string, price double")

    def prices(q):
        df = pricing.invoice_lines_quoted(orders, items, q, settings)
        return [float(r[1]) for r in rows(df, "item_id", "price")]

    assert prices(quoted) == [75.0, 25.0]
    assert prices(quoted.filter("item_id = 'i0'")) == [50.0, 50.0]
    assert prices(quoted.withColumn("price", F.lit(0.0))) == [50.0, 50.0]


def test_quality_rules(spark):
    people = spark.createDataFrame([(1, "A", "123", "x@y", -1.0), (2, "Ama", "0240000000", "a.b@c.org", None)],
                                   "id int, name string, phone string, email string, exchange_rate double")
    checked = {r["id"]: r["violations"] for r in quality.validate_customers(people).collect()}
    assert checked == {1: ["name too short", "phone too short", "email invalid", "exchange_rate not positive"], 2: []}
    assert rows(quality.accepted(quality.validate_customers(people)), "id") == [(2,)]
    child = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "id int, customer_id string")
    parent = spark.createDataFrame([("a",)], "id string")
    assert rows(quality.referential_check(child, parent, "customer_id"), "id") == [(2,)]
