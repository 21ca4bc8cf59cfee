"""Data-quality checks: every row gets the list of rules it breaks."""

from pyspark.sql import Column, DataFrame, functions as F

from cargoframe.schema import (
    CONTAINER_STATUSES, CUSTOMER_STATUSES, DIMENSION_UNITS, ORDER_STATUSES, SHIPPING_TYPES, TIERS,
)

# Limits of the input rules.
MAX_MEASURE = 10_000
MAX_ITEM_MONEY = 500_000
MAX_INVOICE = 1_000_000
MAX_PHOTOS = 20
EMAIL = r"^(?!\.)(?!.*\.\.)[A-Za-z0-9_+.'-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$"


class Rules:
    """Collects (broken?, message) pairs for the columns a frame has."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.tests: list[Column] = []

    def broken(self, name: str, condition: Column, message: str) -> "Rules":
        if name in self.df.columns:
            self.tests.append(F.when(condition, F.lit(message)))
        return self

    def required(self, name, message=None):
        text = F.trim(F.col(name).cast("string")) if name in self.df.columns else None
        return self.broken(name, F.coalesce(text, F.lit("")) == "", message or f"{name} required") \
            if text is not None else self

    def length(self, name, low=0, high=None):
        if name not in self.df.columns:
            return self
        n = F.length(F.coalesce(F.col(name).cast("string"), F.lit("")))
        if low:
            self.broken(name, n < low, f"{name} too short")
        if high is not None:
            self.broken(name, n > high, f"{name} too long")
        return self

    def positive(self, name, high=None):
        if name not in self.df.columns:
            return self
        self.broken(name, F.col(name) <= 0, f"{name} not positive")
        if high is not None:
            self.broken(name, F.col(name) > high, f"{name} too large")
        return self

    def within(self, name, low, high):
        if name not in self.df.columns:
            return self
        return self.broken(name, (F.col(name) < low) | (F.col(name) > high), f"{name} out of range")

    def one_of(self, name, values):
        if name not in self.df.columns:
            return self
        return self.broken(name, ~F.col(name).isin(*values), f"{name} unknown")

    def result(self) -> DataFrame:
        none = F.array().cast("array<string>")
        checks = F.filter(F.array(*self.tests), lambda m: m.isNotNull()) if self.tests else none
        return self.df.withColumn("violations", checks)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") == 0).drop("violations")


def validate_items(items: DataFrame) -> DataFrame:
    rules = Rules(items).required("customer_id").required("date_received")
    for name in ("weight", "length", "width", "height", "quantity"):
        rules.positive(name, MAX_MEASURE)
    rules.one_of("shipping_type", SHIPPING_TYPES).one_of("dimension_unit", DIMENSION_UNITS)
    for name in (
        "est_price", "est_shipping_price", "pkg_est_shipping", "pkg_shipping_rate",
        "special_shipping_rate",
    ):
        rules.within(name, 0, MAX_ITEM_MONEY)
    rules.length("description", high=1000).length("tracking_number", high=100)
    rules.length("notes", high=2000).length("special_rate_name", high=100)
    rules.length("customer_id", high=50).length("order_id", high=50).length("container_id", high=50)
    if "photos" in items.columns:
        rules.broken("photos", F.size("photos") > MAX_PHOTOS, "too many photos")
        urls = F.exists("photos", lambda p: (F.length(p["url"]) > 500) | ~p["url"].contains("://"))
        rules.broken("photos", urls, "bad photo url")
    return rules.result()


def validate_customers(customers: DataFrame) -> DataFrame:
    rules = Rules(customers).length("name", 2, 200).length("phone", 7, 30)
    bad = ~F.coalesce(F.col("email"), F.lit("")).rlike(EMAIL)
    rules.broken("email", bad, "email invalid").length("email", high=254)
    rules.length("notes", high=2000).length("shipping_address", high=500)
    rules.length("shipping_mark", high=50)
    rules.one_of("status", CUSTOMER_STATUSES).one_of("shipping_type", SHIPPING_TYPES)
    return rules.one_of("package", TIERS).positive("exchange_rate").result()


def validate_orders(orders: DataFrame) -> DataFrame:
    rules = Rules(orders).required("customer_id")
    if "item_ids" in orders.columns:
        rules.broken("item_ids", F.size("item_ids") < 1, "at least one item is required")
    rules.positive("invoice_amount", MAX_INVOICE).one_of("status", ORDER_STATUSES)
    if "discount" in orders.columns:
        rules.broken("discount", F.col("discount") < 0, "discount negative")
    return rules.positive("payment_amount").result()


def validate_containers(containers: DataFrame) -> DataFrame:
    rules = Rules(containers).required("tracking_number", "container number required")
    rules.length("tracking_number", high=100).length("name", high=200)
    rules.length("description", high=1000).length("notes", high=2000)
    return rules.one_of("status", CONTAINER_STATUSES).result()


def validate_suppliers(suppliers: DataFrame) -> DataFrame:
    return Rules(suppliers).length("name", 1).within("rating", 1, 5).result()


def validate_warehouses(warehouses: DataFrame) -> DataFrame:
    return Rules(warehouses).required("name").required("address").result()


def validate_special_rates(rates: DataFrame) -> DataFrame:
    return Rules(rates).required("name").result()


def validate_settings(settings: DataFrame) -> DataFrame:
    return Rules(settings).positive("usd_to_local").positive("rate_per_cbm").result()


def validate_reference_data(
    suppliers: DataFrame, warehouses: DataFrame, rates: DataFrame, settings: DataFrame
) -> DataFrame:
    """Broken rows of the reference tables: table, row, violations."""
    settings = settings.withColumn("id", F.lit("settings"))
    checked = {
        "suppliers": validate_suppliers(suppliers),
        "warehouses": validate_warehouses(warehouses),
        "special_rates": validate_special_rates(rates),
        "settings": validate_settings(settings),
    }
    result = None
    for name, df in checked.items():
        rows = df.filter(F.size("violations") > 0).select(
            F.lit(name).alias("table_name"), F.col("id").cast("string").alias("row_id"),
            "violations",
        )
        result = rows if result is None else result.unionByName(rows)
    return result


def referential_check(
    child: DataFrame, parent: DataFrame, fk: str, parent_key: str = "id"
) -> DataFrame:
    """Children whose link points to nothing."""
    keys = parent.select(F.col(parent_key).alias(fk))
    return child.filter(F.col(fk).isNotNull()).join(keys, fk, "left_anti")
