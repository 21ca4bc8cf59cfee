"""Rate-card pricing and cent-exact invoice allocation."""

from pyspark.sql import Column, DataFrame, functions as F

from cargoframe.functions.measures import (
    cbm_total, cbm_unit, cents, fx_rate, net_amount, pieces, round_half_up, to_local,
)
from cargoframe.functions.text import first_line_label, line_label
from cargoframe.functions.times import due_date
from cargoframe.operators.links import rate_card
from cargoframe.operators.windows import group_totals, share_units, split_to_cents, units_total
from cargoframe.schema import MONEY
from cargoframe.sources.scratch import settle


def _with_tier_rates(items: DataFrame, customers: DataFrame, package_rates: DataFrame) -> DataFrame:
    """Adds ``_sea`` and ``_air`` of the customer's tier; basic when the tier is unknown."""
    tiers = customers.select(F.col("id").alias("customer_id"), F.col("package").alias("_tier"))
    card = rate_card(package_rates)
    own = card.select(F.col("tier").alias("_tier"), F.col("sea").alias("_s"), F.col("air").alias("_a"))
    basic = card.filter("tier = 'basic'").select(
        F.col("sea").alias("_bs"), F.col("air").alias("_ba")
    )
    # the card has one row per tier
    joined = (
        items.join(tiers, "customer_id", "left")
        .join(F.broadcast(own), "_tier", "left")
        .crossJoin(F.broadcast(basic))
    )
    return joined.withColumns(
        {"_sea": F.coalesce("_s", "_bs"), "_air": F.coalesce("_a", "_ba")}
    ).drop("_tier", "_s", "_a", "_bs", "_ba")


def _is_air() -> Column:
    return F.coalesce(F.col("shipping_type") == "air", F.lit(False))


def _cost(sea: Column, air: Column) -> Column:
    """Charge of a line, NULL when nothing can be charged."""
    n = pieces(F.col("quantity"))
    weight = F.coalesce(F.col("weight"), F.lit(0.0))
    cost = F.when(_is_air(), weight * n * air).otherwise(cbm_unit() * n * sea)
    return F.when(cost > 0, cost)


def _positive(value: Column) -> Column:
    return F.when(value > 0, value)


def price_items(
    items: DataFrame, customers: DataFrame, package_rates: DataFrame, special_rates: DataFrame
) -> DataFrame:
    """Intake pricing. The tier amount is always kept; a special rate overrides the estimate."""
    special = special_rates.select(
        F.col("name").alias("special_rate_name"), F.col("sea").alias("_ssea"),
        F.col("air").alias("_sair"), F.lit(True).alias("_special"),
    )
    rated = _with_tier_rates(items, customers, package_rates).join(
        special, "special_rate_name", "left"
    )
    sea, air = F.col("_sea"), F.col("_air")
    tier_cost = _cost(sea, air)
    special_cost = _cost(F.col("_ssea"), F.col("_sair"))
    found = F.col("_special").isNotNull()
    estimate = F.coalesce(F.when(found, special_cost), tier_cost)
    return rated.withColumns(
        {
            "est_shipping_price": round_half_up(estimate),
            "pkg_est_shipping": tier_cost,
            "pkg_shipping_rate": _positive(F.when(_is_air(), air).otherwise(sea)),
            "special_shipping_rate": F.when(_is_air(), F.col("_sair")).otherwise(F.col("_ssea")),
            "is_special_item": F.coalesce("is_special_item", F.lit(False)) | found,
        }
    ).select(items.columns)


def reprice_items(items: DataFrame, customers: DataFrame, package_rates: DataFrame) -> DataFrame:
    """Pricing after an edit: tier rates only; lines that cannot be charged keep their values."""
    rated = _with_tier_rates(items, customers, package_rates)
    cost = round_half_up(_cost(F.col("_sea"), F.col("_air")))
    boxed = cbm_unit() != 0
    rate = _positive(F.when(_is_air(), F.col("_air")).when(boxed, F.col("_sea")))
    return rated.withColumns(
        {
            "est_shipping_price": F.coalesce(cost, F.col("est_shipping_price").cast("double")),
            "pkg_est_shipping": F.coalesce(cost, F.col("pkg_est_shipping").cast("double")),
            "pkg_shipping_rate": F.coalesce(rate, F.col("pkg_shipping_rate")),
        }
    ).select(items.columns)


def estimate_position(items: DataFrame) -> DataFrame:
    shown = F.coalesce("est_shipping_price", "pkg_est_shipping", F.lit(0.0))
    return items.select("id", shown.cast("double").alias("estimate_total"))


def _order_heads(orders: DataFrame, settings: DataFrame) -> DataFrame:
    """Unpaid orders with the net amount in local currency."""
    fx = settings.limit(1).select(F.col("usd_to_local").alias("_fx"))
    amount = to_local(F.col("invoice_amount"), F.col("_fx"))
    given = F.when(F.col("discount") > 0, F.col("discount")).otherwise(F.lit(0))
    discount = to_local(given, F.col("_fx"))
    net = F.greatest(F.lit(0.0), round_half_up(amount - discount))
    unpaid = orders.filter(F.coalesce(F.col("status"), F.lit("")) != "Paid")
    return unpaid.join(F.broadcast(fx), F.lit(True), "left").select(
        F.col("id").alias("order_id"), "order_ref", net.alias("net")
    )


def _attached(heads: DataFrame, totals: DataFrame, lines: DataFrame) -> DataFrame:
    """Order lines with head and group totals. An order without items keeps one row with a NULL
    item. Both sides are shuffled straight below the join with the lines."""
    return heads.join(totals, "order_id", "left").join(lines, "order_id", "left")


def _freight_label() -> Column:
    return F.concat(F.lit("Freight - "), F.col("order_ref"))


def _item_lines(items: DataFrame) -> DataFrame:
    return items.select(
        "order_id", F.col("id").alias("item_id"), line_label().alias("_label"),
        cbm_total().alias("cbm"),
    ).filter("order_id IS NOT NULL")


def _shaped(lines: DataFrame) -> DataFrame:
    return lines.select(
        "order_id", "item_id",
        F.coalesce("_label", _freight_label()).alias("item_name"), "price",
    )


def invoice_lines(orders: DataFrame, items: DataFrame, settings: DataFrame) -> DataFrame:
    """Net amount of every unpaid order split over its items by volume, else equally.

    The last item (by id) takes the rounding remainder; an order without items gives one line.
    """
    lines = _item_lines(items).withColumn("_units", share_units(F.col("cbm"))).drop("cbm")
    totals = group_totals(lines, ["item_id"], "order_id")
    rows = _attached(_order_heads(orders, settings), totals, lines)
    return _shaped(split_to_cents(rows, "net", ["item_id"], "order_id", "price"))


def invoice_lines_equal(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Lines of the invoice issued with a new order: equal shares, no remainder fix."""
    heads = orders.select(F.col("id").alias("order_id"), "order_ref", "invoice_amount")
    lines = items.select(
        "order_id", F.col("id").alias("item_id"), first_line_label().alias("_label")
    ).filter("order_id IS NOT NULL")
    counts = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("invoice_amount").cast("double") / F.coalesce("_n", F.lit(1))
    return _shaped(_attached(heads, counts, lines).withColumn("price", cents(share)))


def invoice_lines_quoted(
    orders: DataFrame, items: DataFrame, quoted: DataFrame, settings: DataFrame
) -> DataFrame:
    """Split by the supplied prices (item_id, price) where all items of an order have one.

    Other orders are split as in ``invoice_lines``; prices that add up to zero split equally. Lines
    with their prices, and priced lines, are written once: their columns would else move for every use.
    """
    prices = quoted.select("item_id", F.col("price").cast("double").alias("_quote"))
    lines = _item_lines(items).join(prices, "item_id", "left").select(
        "order_id", "item_id", "_label", share_units(F.col("cbm")).alias("_units"),
        share_units(F.col("_quote")).alias("_quoted"),
    )
    lines = settle(lines, "quoted", lean=True)
    totals = lines.groupBy("order_id").agg(
        units_total("_units").alias("_volume"), units_total("_quoted").alias("_asked"),
        (F.count("_quoted") == F.count(F.lit(1))).alias("_full"),
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("item_id")).alias("_end"),
    )
    rows = _attached(_order_heads(orders, settings), totals, lines).withColumns(
        {
            "_units": F.when(F.col("_full"), F.col("_quoted")).otherwise(F.col("_units")),
            "_total": F.when(F.col("_full"), F.col("_asked")).otherwise(F.col("_volume")),
        }
    ).drop("_quoted", "_asked", "_volume", "_full")
    return _shaped(split_to_cents(rows, "net", ["item_id"], "order_id", "price", keep=True))


def volume_quotes(requests: DataFrame, package_rates: DataFrame) -> DataFrame:
    """Sea quotes for boxes (length, width, height, dimension_unit, quantity, tier)."""
    card = rate_card(package_rates)
    own = card.select("tier", F.col("sea").alias("_sea"))
    basic = card.filter("tier = 'basic'").select(F.col("sea").alias("_basic"))
    rated = requests.join(F.broadcast(own), "tier", "left").crossJoin(F.broadcast(basic))
    single = F.nullif(cbm_unit(), F.lit(0.0))
    total = single * pieces(F.col("quantity"))
    price = round_half_up(total * F.coalesce("_sea", "_basic"))
    return rated.select(
        *requests.columns, single.alias("cbm_single"), total.alias("cbm_all"), price.alias("price")
    )


def landed_cost(shipments: DataFrame) -> DataFrame:
    """Shipments: product, origin_freight, mode, cbm, weight, sea_rate, air_rate, duty_pct,
    agent_fee, usd_to_local; a missing number counts as 0."""

    def n(name):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    freight = F.when(F.col("mode") == "sea", n("cbm") * n("sea_rate")).otherwise(
        n("weight") * n("air_rate")
    )
    with_freight = shipments.withColumn("intl_freight", freight)
    subtotal = n("product") + n("origin_freight") + F.col("intl_freight")
    with_subtotal = with_freight.withColumn("subtotal", subtotal)
    duty = F.col("subtotal") * (n("duty_pct") / 100)
    with_duty = with_subtotal.withColumn("duty", duty)
    total = F.col("subtotal") + F.col("duty") + n("agent_fee")
    with_total = with_duty.withColumn("total_usd", total)
    return with_total.withColumn("total_local", F.col("total_usd") * n("usd_to_local"))


def order_net_view(orders: DataFrame, settings: DataFrame) -> DataFrame:
    """Base, discount and net in both currencies; the balance in local currency."""
    fx = settings.limit(1).select(F.col("usd_to_local").alias("_fx"))
    rate = fx_rate(F.col("_fx"))
    base = F.col("invoice_amount").cast("double")
    discount = F.coalesce(F.col("discount"), F.lit(0).cast(MONEY)).cast("double")
    net = net_amount(base, discount)
    paid = F.coalesce(F.col("amount_paid").cast("double"), F.lit(0.0))
    return orders.join(F.broadcast(fx), F.lit(True), "left").select(
        F.col("id").alias("order_id"),
        base.alias("base_usd"), (base * rate).alias("base_local"),
        discount.alias("discount_usd"), (discount * rate).alias("discount_local"),
        net.alias("net_usd"), (net * rate).alias("net_local"),
        F.greatest(F.lit(0.0), base * rate - paid).alias("balance_local"),
    )


def sale_dates(orders: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Issue and due date of the sale that is opened for an order; without an invoice date it is
    issued on the day of ``as_of``."""
    issued = F.coalesce(F.col("invoice_date").cast("date"), F.lit(as_of).cast("date"))
    return orders.select("id", issued.alias("issue_date"), due_date(issued, days).alias("due_date"))
