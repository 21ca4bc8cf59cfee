"""Canonical orders, pages and short lists."""

from pyspark.sql import DataFrame, functions as F

from cargoframe.functions.measures import cbm_total, charge_basis
from cargoframe.operators.filters import report_range
from cargoframe.operators.skew import Order, number_rows, order_by, rows_between
from cargoframe.schema import UNPAID

# The order in which each table is listed.
CANONICAL_ORDER = {
    "items": ("date_received", "desc"),
    "customers": ("created_at", "desc"),
    "orders": ("created_at", "desc"),
    "containers": ("created_at", "desc"),
    "suppliers": ("created_at", "desc"),
    "users": ("last_login", "desc"),
    "registrations": ("submitted_at", "desc"),
    "warehouses": ("created_at", "asc"),
    "record_history": ("changed_at", "asc"),
    "status_history": ("changed_at", "desc"),
    "activity_logs": ("timestamp", "desc"),
}
# The longest page of a list, by table and otherwise.
LONGEST_PAGE, LONGEST_OTHER = {"customers": 1000}, 500


def canonical_order(table: str) -> Order:
    return [CANONICAL_ORDER[table], ("id", "asc")]


def list_sorted(df: DataFrame, table: str) -> DataFrame:
    return df.orderBy(*order_by(canonical_order(table)))


def positions(df: DataFrame, table: str) -> DataFrame:
    """(id, position) of every row in the order in which its table is listed."""
    column, _ = CANONICAL_ORDER[table]
    return number_rows(df.select("id", column), canonical_order(table), "position").select("id", "position")


def charged_as(items: DataFrame) -> DataFrame:
    """What a list shows as the size of an item: its volume, else its weight, else nothing."""
    basis = charge_basis()
    return items.select(
        "id", basis.alias("basis"),
        F.when(basis == "volume", cbm_total()).when(basis == "weight", F.col("weight")).alias("amount"))


def page_size(table: str, asked: int | None = None) -> int:
    """Rows of a page of this table: 50 unless asked otherwise, at most the table's longest page."""
    return min(asked, LONGEST_PAGE.get(table, LONGEST_OTHER)) if asked and asked > 0 else 50


def page_info(df: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """One row: total, total_pages (at least 1), has_more, from_row, to_row."""
    total = F.col("total")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.greatest(F.lit(1), F.ceil(total / limit)).cast("bigint").alias("total_pages"),
        F.lit(page).cast("bigint").alias("page"),
        (F.lit(page) * limit < total).alias("has_more"),
        F.lit((page - 1) * limit + 1).cast("bigint").alias("from_row"),
        F.least(F.lit(page * limit).cast("bigint"), total).alias("to_row"),
    )


def paginate(df: DataFrame, page: int, limit: int, order: Order) -> DataFrame:
    """One page of ``limit`` rows; the order must be total, so that pages partition the list.

    A page at any depth is found by the row counts of ranges, and only the ranges that hold it
    are sorted.
    """
    if limit < 1:
        raise ValueError("a page holds at least one row; see page_size")
    return rows_between(df, order, (max(1, page) - 1) * limit, limit)


def page_after(df: DataFrame, table: str, last_value, last_id, limit: int = 50) -> DataFrame:
    """The page following a known row: a pushed filter and a top-k at any depth.

    A NULL ``last_value`` means that the dated rows are behind.
    """
    column, direction = CANONICAL_ORDER[table]
    value = F.col(column)
    if last_value is None:
        rest = value.isNull() & (F.col("id") > last_id)
    else:
        last = F.lit(last_value)
        beyond = value < last if direction == "desc" else value > last
        rest = beyond | ((value == last) & (F.col("id") > last_id)) | value.isNull()
    return list_sorted(df.filter(rest), table).limit(limit)


def recent_orders(orders: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """Newest orders with their number of items; items are counted for those orders only."""
    newest = orders.orderBy(F.desc_nulls_last("created_at"), "id").limit(n)
    ids = newest.select(F.col("id").alias("order_id"))
    counts = items.join(F.broadcast(ids), "order_id", "left_semi").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    joined = newest.join(F.broadcast(counts), newest["id"] == counts["order_id"], "left")
    return joined.select(
        "id", "order_ref", "customer_name", "invoice_amount",
        F.coalesce("invoice_date", "created_at").alias("invoice_date"), "status",
        F.coalesce("_n", F.lit(0)).alias("item_count"),
    )


def recent_shipments(items: DataFrame, n: int = 5) -> DataFrame:
    return list_sorted(items, "items").limit(n).select(
        "id", "item_ref", "customer_name", "container_name", "status", "tracking_number",
        "date_received",
    )


def pending_orders(orders: DataFrame) -> DataFrame:
    return list_sorted(orders.filter(F.col("status") == "Pending"), "orders")


def outstanding_payments(
    orders: DataFrame, customers: DataFrame, date_from=None, date_to=None
) -> DataFrame:
    """Unpaid orders, oldest invoice first, orders without an invoice date last."""
    unpaid = report_range(orders, date_from, date_to).filter(F.col("status").isin(*UNPAID))
    names = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("_name"))
    stored = F.when(F.col("customer_name") != "", F.col("customer_name"))
    looked_up = F.when(F.col("customer_id").isNotNull(), F.coalesce("_name", F.lit("Unknown")))
    return (
        unpaid.join(names, "customer_id", "left")
        .select(
            "id", "order_ref", F.coalesce(stored, looked_up, F.lit("")).alias("customer_name"),
            "invoice_amount", "invoice_date", "status",
        )
        .orderBy(F.asc_nulls_last("invoice_date"), "id")
    )


def latest_activity(activity: DataFrame, n: int = 100) -> DataFrame:
    return list_sorted(activity, "activity_logs").limit(n)
