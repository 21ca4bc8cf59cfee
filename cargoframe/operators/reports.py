"""Revenue, volume and status aggregates."""

from pyspark.sql import Column, DataFrame, functions as F

from cargoframe.functions.measures import cbm_total, cbm_unit, round_half_up
from cargoframe.functions.times import day, month_key, month_start
from cargoframe.operators.filters import period_filter, report_date, report_range
from cargoframe.operators.windows import dedupe_tracking
from cargoframe.schema import (
    ARRIVED, COMPLETED, MONEY, READY, RECEIVED, SHIPPED, SORTING, UNPAID,
)


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _amount(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("invoice_amount"))), _zero())


def _is(status: str) -> Column:
    return F.col("status") == status


def _unpaid() -> Column:
    return F.col("status").isin(*UNPAID)


def _rows() -> Column:
    return F.count(F.lit(1))


def revenue_totals(orders: DataFrame, date_from=None, date_to=None) -> DataFrame:
    totals = report_range(orders, date_from, date_to).agg(
        _amount(_is("Paid")).alias("total_revenue"),
        _amount(_is("Pending")).alias("pending_revenue"),
        _rows().alias("total_orders"),
        F.count_if(_is("Paid")).alias("paid_orders"),
    )
    average = F.when(
        F.col("paid_orders") > 0, F.col("total_revenue").cast("double") / F.col("paid_orders")
    ).otherwise(F.lit(0.0))
    return totals.withColumn("avg_order_value", average)


def revenue_current(orders: DataFrame, as_of, date_from=None, date_to=None) -> DataFrame:
    """Paid revenue of the month and the year of ``as_of``, inside the report range."""
    when, now = report_date().cast("date"), day(as_of)
    paid = _is("Paid")
    return report_range(orders, date_from, date_to).agg(
        _amount(paid & (F.trunc(when, "month") == F.trunc(now, "month"))).alias("revenue_this_month"),
        _amount(paid & (F.trunc(when, "year") == F.trunc(now, "year"))).alias("revenue_this_year"),
    )


def _months(df: DataFrame, as_of, months: int) -> DataFrame:
    first = F.add_months(month_start(day(as_of)), -(months - 1))
    return df.sparkSession.range(months).select(
        F.add_months(first, F.col("id").cast("int")).alias("_month")
    )


def _by_month(df: DataFrame, when: Column, as_of, months: int, value: Column, name: str):
    """One row per calendar month ending with that of ``as_of``; only those months are read."""
    start = month_start(day(as_of))
    recent = df.filter(
        (when >= F.add_months(start, -(months - 1)).cast("timestamp_ntz"))
        & (when < F.add_months(start, 1).cast("timestamp_ntz"))
    )
    sums = recent.groupBy(month_start(when).alias("_month")).agg(value.alias(name))
    spine = _months(df, as_of, months)
    # at most one row per month on either side
    return spine.join(F.broadcast(sums), "_month", "left").select(
        month_key(F.col("_month")).alias("month"), name
    )


def monthly_revenue(orders: DataFrame, as_of, months: int = 12) -> DataFrame:
    paid = orders.filter(_is("Paid"))
    result = _by_month(
        paid, report_date(), as_of, months, F.sum("invoice_amount"), "revenue"
    )
    return result.withColumn("revenue", F.coalesce("revenue", _zero()))


def monthly_shipments(items: DataFrame, as_of, months: int = 12) -> DataFrame:
    result = _by_month(items, F.col("date_received"), as_of, months, _rows(), "shipments")
    return result.na.fill(0, ["shipments"])


def top_customers(
    orders: DataFrame, customers: DataFrame, date_from=None, date_to=None, n: int = 10
) -> DataFrame:
    """Best customers by paid revenue; only the n winners are joined to their names."""
    paid = report_range(orders, date_from, date_to).filter(
        _is("Paid") & F.col("customer_id").isNotNull()
    )
    best = (
        paid.groupBy("customer_id")
        .agg(F.sum("invoice_amount").alias("revenue"), _rows().alias("orders"))
        .orderBy(F.desc("revenue"), "customer_id")
        .limit(n)
    )
    names = customers.select(F.col("id").alias("customer_id"), "name")
    winners = names.join(F.broadcast(best.select("customer_id")), "customer_id", "left_semi")
    return best.join(F.broadcast(winners), "customer_id", "left").select(
        "customer_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "revenue", "orders"
    ).orderBy(F.desc("revenue"), "customer_id")


def customer_analytics(
    orders: DataFrame, customers: DataFrame, date_from=None, date_to=None
) -> DataFrame:
    """Every customer, plus ids seen only on orders as Unknown; aggregated before the join."""
    per_customer = (
        report_range(orders, date_from, date_to)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            _rows().alias("total_orders"),
            _amount(_is("Paid")).alias("total_revenue"),
            _amount(_unpaid()).alias("outstanding_balance"),
        )
    )
    names = customers.select(F.col("id").alias("customer_id"), "name")
    return names.join(per_customer, "customer_id", "full_outer").select(
        "customer_id",
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("total_revenue", _zero()).alias("total_revenue"),
        F.coalesce("outstanding_balance", _zero()).alias("outstanding_balance"),
    )


def total_shipments(items: DataFrame) -> DataFrame:
    return items.agg(_rows().alias("total_shipments"))


def admin_counters(
    customers: DataFrame, items: DataFrame, containers: DataFrame, orders: DataFrame
) -> DataFrame:
    """One pass per table, then one row."""
    people = customers.agg(
        _rows().alias("total_customers"), F.count_if(_is("active")).alias("active_customers")
    )
    goods = items.agg(
        F.count_if(_is(RECEIVED)).alias("items_in_warehouse"),
        F.count_if(_is(SORTING)).alias("items_in_sorting"),
        F.count_if(_is(READY)).alias("ready_for_pickup"),
        F.count_if(F.col("is_missing")).alias("lost_items"),
    )
    boxes = containers.agg(F.count_if(_is("Shipped to Ghana")).alias("containers_in_transit"))
    money = orders.agg(
        _amount(_is("Paid")).alias("total_revenue"),
        _amount(_is("Pending")).alias("pending_revenue"),
    )
    return people.crossJoin(goods).crossJoin(boxes).crossJoin(money)


def items_by_status(items: DataFrame) -> DataFrame:
    return items.groupBy(F.coalesce("status", F.lit("Unknown")).alias("status")).agg(
        _rows().alias("n")
    )


def total_cbm(items: DataFrame) -> DataFrame:
    return items.agg(F.coalesce(F.sum(cbm_unit()), F.lit(0.0)).alias("total_cbm"))


def orders_this_month(orders: DataFrame, as_of) -> DataFrame:
    same = month_start(report_date()) == month_start(day(as_of))
    return orders.agg(F.count_if(same).alias("orders_this_month"))


def _per_container(containers: DataFrame, items: DataFrame, value: Column, name: str):
    sums = items.filter(F.col("container_id").isNotNull()).groupBy("container_id").agg(
        value.alias(name)
    )
    heads = containers.select(F.col("id").alias("container_id"), "container_ref")
    return heads.join(sums, "container_id", "left")


def container_cbm(containers: DataFrame, items: DataFrame) -> DataFrame:
    """Unit volume of all items in each container, 0 for an empty one."""
    result = _per_container(containers, items, F.sum(cbm_unit()), "total_cbm")
    return result.na.fill(0.0, ["total_cbm"])


def container_item_count(containers: DataFrame, items: DataFrame) -> DataFrame:
    return _per_container(containers, items, _rows(), "item_count").na.fill(0, ["item_count"])


def customer_dashboard(customers: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    goods = items.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        _rows().alias("total_items"), F.sum(cbm_unit()).alias("total_cbm")
    )
    bills = orders.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        _rows().alias("total_orders"), _amount(_is("Pending")).alias("pending_payment")
    )
    people = customers.select(F.col("id").alias("customer_id"), "name")
    joined = people.join(goods, "customer_id", "left").join(bills, "customer_id", "left")
    return joined.select(
        "customer_id",
        "name",
        F.coalesce("total_items", F.lit(0)).alias("total_items"),
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("pending_payment", _zero()).alias("pending_payment"),
        F.coalesce("total_cbm", F.lit(0.0)).alias("total_cbm"),
    )


def customer_cards(
    items: DataFrame, orders: DataFrame, period: str, as_of=None, date_from=None, date_to=None
) -> DataFrame:
    """Dashboard cards of every customer for a period; repeated tracking numbers count once."""
    known = F.col("customer_id").isNotNull()
    latest = dedupe_tracking(items.filter(known), within=("customer_id",))
    goods = period_filter(latest, "date_received", period, as_of, date_from, date_to)
    goods = goods.groupBy("customer_id").agg(
        _rows().alias("items"),
        F.count_if(_is(READY)).alias("ready"),
        F.sum(cbm_unit()).alias("cbm"),
        F.count_if(F.col("status") != COMPLETED).alias("active"),
        F.count_if(F.col("status").isin(SHIPPED, ARRIVED)).alias("in_transit"),
        F.count_if(F.col("status").isin(COMPLETED, READY)).alias("delivered"),
    )
    bills = period_filter(
        orders.filter(known), "invoice_date", period, as_of, date_from, date_to
    )
    bills = bills.groupBy("customer_id").agg(
        _rows().alias("orders"), _amount(_unpaid()).alias("unpaid")
    )
    counts = ["items", "ready", "active", "in_transit", "delivered", "orders"]
    joined = goods.join(bills, "customer_id", "full_outer")
    return joined.na.fill(0, counts).na.fill(0.0, ["cbm"]).withColumn(
        "unpaid", F.coalesce("unpaid", _zero())
    )


def customer_status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("customer_id", "status").agg(_rows().alias("n"))


def sorting_counts(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count_if(_is(SORTING)).alias("sorting_count"),
        F.count_if(F.col("is_missing")).alias("missing_count"),
    )


def sorting_by_container(items: DataFrame, containers: DataFrame) -> DataFrame:
    """Items in sorting per container, counted before the name is looked up."""
    counts = items.filter(_is(SORTING)).groupBy("container_id").agg(_rows().alias("n"))
    names = containers.select(
        F.col("id").alias("container_id"), F.coalesce("name", "container_ref").alias("_name")
    )
    label = F.coalesce("_name", F.col("container_id").cast("string"), F.lit("No Container"))
    return counts.join(names, "container_id", "left").select(
        "container_id", label.alias("container_name"), "n"
    )


def collection_rate(orders: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Paid orders as a whole percentage of all orders, NULL without orders."""
    counts = report_range(orders, date_from, date_to).agg(
        _rows().alias("n"), F.count_if(_is("Paid")).alias("paid")
    )
    percent = F.floor(F.col("paid") / F.col("n") * 100 + 0.5)
    return counts.select(F.when(F.col("n") > 0, percent).alias("collection_rate"))


def order_cbm(orders: DataFrame, items: DataFrame) -> DataFrame:
    sums = items.filter(F.col("order_id").isNotNull()).groupBy("order_id").agg(
        F.sum(cbm_total()).alias("total_cbm")
    )
    heads = orders.select(F.col("id").alias("order_id"))
    return heads.join(sums, "order_id", "left").na.fill(0.0, ["total_cbm"])


def invoice_value(items: DataFrame, key: str) -> DataFrame:
    """Amount to invoice per customer or order: tier estimate first, then the shown estimate."""
    estimate = F.coalesce("pkg_est_shipping", "est_shipping_price", _zero())
    sums = items.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(estimate).alias("_sum"))
    return sums.select(key, round_half_up(F.col("_sum")).alias("invoice_value"))
