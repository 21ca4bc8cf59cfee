"""Predicates, searches, periods and row-level scopes."""

from pyspark.sql import Column, DataFrame, functions as F

from cargoframe.functions.text import contains_any
from cargoframe.functions.times import between_days, moment, since
from cargoframe.operators.skew import join_unique
from cargoframe.schema import RECEIVED


def _equals(df: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def filter_items(
    items: DataFrame, status=None, is_missing=None, customer_id=None, container_id=None,
    order_id=None,
) -> DataFrame:
    return _equals(
        items, status=status, is_missing=is_missing, customer_id=customer_id,
        container_id=container_id, order_id=order_id,
    )


def search_any(df: DataFrame, columns, needle: str | None) -> DataFrame:
    return df.filter(contains_any(columns, needle)) if needle else df


ITEM_SEARCH = (
    "item_ref", "description", "tracking_number", "customer_shipping_mark", "customer_name",
)


def search_items(items_with_customer: DataFrame, needle: str | None) -> DataFrame:
    return search_any(items_with_customer, ITEM_SEARCH, needle)


def search_customers(
    customers: DataFrame, needle: str | None = None, status: str | None = None
) -> DataFrame:
    """A phone typed with the country prefix also finds numbers stored in local form."""
    customers = _equals(customers, status=status)
    if not needle:
        return customers
    test = contains_any(("name", "email", "shipping_mark", "phone"), needle)
    local = needle.lower()
    for prefix in ("+233", "00233"):
        if local.startswith(prefix):
            local = "0" + local[len(prefix):]
    if local != needle.lower():
        test = test | contains_any(("phone",), local)
    return customers.filter(test)


def search_orders(
    orders_with_customer: DataFrame, status=None, customer_id=None, needle: str | None = None
) -> DataFrame:
    found = _equals(orders_with_customer, status=status, customer_id=customer_id)
    return search_any(found, ("order_ref", "customer_name"), needle)


def search_containers(containers: DataFrame, status=None, needle: str | None = None) -> DataFrame:
    found = _equals(containers, status=status)
    return search_any(found, ("container_ref", "name", "tracking_number"), needle)


def search_suppliers(suppliers: DataFrame, needle: str | None = None, category=None) -> DataFrame:
    found = _equals(suppliers, category=category)
    return search_any(found, ("name", "category", "platform"), needle)


def period_filter(
    df: DataFrame, column: str, period: str, as_of=None, date_from=None, date_to=None
) -> DataFrame:
    """all, today, week, month, year (ending at ``as_of``) or custom (inclusive days)."""
    return df.filter(in_period(F.col(column), period, as_of, date_from, date_to))


def in_period(column: Column, period: str, as_of=None, date_from=None, date_to=None) -> Column:
    if period in ("", "all") or (period == "custom" and date_from is None and date_to is None):
        return F.lit(True)
    if period == "custom":
        return between_days(column, date_from, date_to)
    return (column >= since(period, as_of)) & (column <= moment(as_of))


def report_date() -> Column:
    return F.coalesce("invoice_date", "created_at")


def report_range(orders: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Orders whose invoice date, else creation date, lies in the inclusive day range."""
    if date_from is None and date_to is None:
        return orders
    return orders.filter(between_days(report_date(), date_from, date_to))


def scope_to_customer(df: DataFrame, principals: DataFrame) -> DataFrame:
    """Rows of the customers that the given principals stand for."""
    return df.join(principals.select("customer_id"), "customer_id", "left_semi")


def unloaded_items(items: DataFrame) -> DataFrame:
    return items.filter((F.col("status") == RECEIVED) & F.col("container_id").isNull())


def uninvoiced_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("order_id").isNull())


def staff_users(users: DataFrame) -> DataFrame:
    return users.filter(F.col("role").isin("super_admin", "warehouse_staff"))


def active_warehouses(warehouses: DataFrame) -> DataFrame:
    return warehouses.filter("is_active").orderBy("created_at", "id")


def registrations_queue(registrations: DataFrame, status: str | None = None) -> DataFrame:
    return _equals(registrations, status=status).orderBy(F.desc("submitted_at"), "id")


def pending_registrations(registrations: DataFrame) -> DataFrame:
    return registrations.agg(F.count_if(F.col("status") == "Pending").alias("pending"))


def match_customers(customers: DataFrame, probes: DataFrame) -> DataFrame:
    """First customer (lowest id) for each probe (probe_id, kind, value), else NULL.

    ``kind`` is login_uid, phone or email. Customers are reduced to one row per value
    before the join, so a value shared by many customers does not multiply.
    """
    kinds = ("login_uid", "phone", "email")
    pairs = customers.select(
        "id",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])
        ).alias("p"),
    ).select("id", "p.kind", "p.value")
    first = pairs.filter("value <> ''").groupBy("kind", "value").agg(
        F.min("id").alias("customer_id")
    )
    return join_unique(probes, first, ["kind", "value"], "left").select(
        "probe_id", "kind", "value", "customer_id"
    )
