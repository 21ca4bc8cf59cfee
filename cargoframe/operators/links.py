"""Joins between the tables.

Size decides the strategy: only frames with a fixed bound carry a broadcast hint, the
rest is left to adaptive execution, which also splits skewed sort-merge partitions.
"""

from pyspark.sql import DataFrame, functions as F

from cargoframe.schema import DEFAULT_DIAL_CODE, DEFAULT_RATES


def items_with_customer(items: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer name and mark, filled only where the item has none."""
    side = customers.select(
        F.col("id").alias("customer_id"),
        F.col("name").alias("_name"),
        F.col("shipping_mark").alias("_mark"),
    )
    return (
        items.join(side, "customer_id", "left")
        .withColumns(
            {
                "customer_name": F.coalesce("customer_name", "_name"),
                "customer_shipping_mark": F.coalesce("customer_shipping_mark", "_mark"),
            }
        )
        .drop("_name", "_mark")
    )


def orders_with_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer name; the customer table wins over the stored name."""
    side = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("_name"))
    return (
        orders.join(side, "customer_id", "left")
        .withColumn("customer_name", F.coalesce("_name", "customer_name"))
        .drop("_name")
    )


def items_with_eta(items: DataFrame, containers: DataFrame) -> DataFrame:
    side = containers.select(F.col("id").alias("container_id"), F.col("eta").alias("container_eta"))
    return items.join(side, "container_id", "left")


def container_manifest(
    containers: DataFrame, items: DataFrame, customers: DataFrame
) -> DataFrame:
    """One row per container and distinct item loaded in it, with the customer filled in.

    Kept flat: a nested list would gather a whole container in one task. Repeated items are
    dropped before the join, and nothing above it needs its partitioning, so adaptive execution
    can split a container that holds a third of all items.
    """
    head = containers.select(
        F.col("id").alias("container_id"), "container_ref",
        F.col("status").alias("container_status"), "eta",
    )
    once = items.filter("container_id IS NOT NULL").dropDuplicates(["id", "container_id"])
    return items_with_customer(head.join(once, "container_id"), customers)


def manifest_from_links(
    containers: DataFrame, items: DataFrame, customers: DataFrame
) -> DataFrame:
    """Manifest for sources that keep the link as an id array on the container."""
    links = containers.select(
        F.col("id").alias("container_id"), "container_ref",
        F.explode(F.array_distinct("item_ids")).alias("id"),
    )
    return items_with_customer(links.join(items.drop("container_id"), "id"), customers)


def order_detail(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per order and item of it; links to items that do not exist are dropped."""
    head = orders.select(
        F.col("id").alias("order_id"), "order_ref", F.col("status").alias("order_status"),
        "invoice_amount",
    )
    return head.join(items.drop("order_ref"), "order_id")


def customer_profile(customers: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers with their number of items and orders; facts are counted before the join."""
    counts = [
        fact.filter(F.col("customer_id").isNotNull())
        .groupBy(F.col("customer_id").alias("id"))
        .agg(F.count(F.lit(1)).alias(name))
        for fact, name in ((items, "total_items"), (orders, "total_orders"))
    ]
    joined = customers.join(counts[0], "id", "left").join(counts[1], "id", "left")
    return joined.na.fill(0, ["total_items", "total_orders"])


def users_with_customer(users: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer logins get their customer's details; a name of their own is kept."""
    side = customers.select(
        F.col("id").alias("customer_id"), F.col("name").alias("_name"), "shipping_mark",
        "shipping_address", "phone", "package", "preferred_warehouse_id",
    )
    fits = (F.col("u.role") == "customer") & (F.col("u.customer_id") == F.col("c.customer_id"))
    joined = users.alias("u").join(side.alias("c"), fits, "left")
    return joined.select(
        "u.id", "u.login_uid", "u.email", "u.role", "u.customer_id",
        F.coalesce("u.customer_name", "c._name").alias("customer_name"),
        "c.shipping_mark", "c.shipping_address", "c.phone", "c.package",
        "c.preferred_warehouse_id", "u.created_at", "u.last_login",
    )


def containers_by_ids(containers: DataFrame, ids: DataFrame) -> DataFrame:
    return containers.join(ids.select("id"), "id", "left_semi")


def preferred_warehouse(customers: DataFrame, warehouses: DataFrame) -> DataFrame:
    """The warehouse a customer chose, else the oldest one."""
    oldest = warehouses.orderBy("created_at", "id").limit(1).select(
        F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("address").alias("_address")
    )
    chosen = warehouses.select(
        F.col("id").alias("preferred_warehouse_id"),
        F.col("name").alias("warehouse_name"), F.col("address").alias("warehouse_address"),
        F.lit(True).alias("_found"),
    )
    joined = customers.join(chosen, "preferred_warehouse_id", "left").join(
        F.broadcast(oldest), F.lit(True), "left"
    )
    found = F.col("_found").isNotNull()
    return joined.select(
        customers["id"].alias("customer_id"),
        customers["shipping_mark"],
        F.when(found, F.col("preferred_warehouse_id")).otherwise(F.col("_id")).alias("warehouse_id"),
        F.when(found, F.col("warehouse_name")).otherwise(F.col("_name")).alias("warehouse_name"),
        F.when(found, F.col("warehouse_address")).otherwise(F.col("_address"))
        .alias("warehouse_address"),
    )


def users_of_customers(users: DataFrame, customer_ids: DataFrame) -> DataFrame:
    return users.join(customer_ids.select("customer_id"), "customer_id", "left_semi")


def rate_card(package_rates: DataFrame) -> DataFrame:
    """One row per known tier: the stored rate, else the built-in default."""
    defaults = package_rates.sparkSession.createDataFrame(
        list(DEFAULT_RATES), "tier string, _sea double, _air double"
    )
    rank = F.col("id") if "id" in package_rates.columns else F.lit(0)
    known = package_rates.filter(F.col("tier").isin([r[0] for r in DEFAULT_RATES]))
    stored = known.groupBy("tier").agg(
        F.max(F.struct(rank.alias("id"), "sea", "air")).alias("r")
    )
    return defaults.join(F.broadcast(stored), "tier", "left").select(
        "tier",
        F.coalesce("r.sea", "_sea").alias("sea"),
        F.coalesce("r.air", "_air").alias("air"),
    )


def phone_country(customers: DataFrame, country_codes) -> DataFrame:
    """Dialling code by longest matching prefix, tested on the phone text as stored."""
    by_length: dict[int, list[str]] = {}
    for code in country_codes:
        by_length.setdefault(len(code), []).append(code)
    phone = F.col("phone")
    tests = [
        F.when(F.substring(phone, 1, n).isin(codes), F.substring(phone, 1, n))
        for n, codes in sorted(by_length.items(), reverse=True)
    ]
    code = F.coalesce(*tests)
    rest = F.trim(F.expr("substring(phone, length(_code) + 1)"))
    return (
        customers.withColumn("_code", code)
        .select(
            F.col("id").alias("customer_id"),
            "phone",
            F.coalesce("_code", F.lit(DEFAULT_DIAL_CODE)).alias("dial_code"),
            F.when(F.col("_code").isNotNull(), rest)
            .otherwise(F.coalesce(F.regexp_replace(phone, r"^\+", ""), F.lit("")))
            .alias("local_number"),
        )
    )


def link_users_by_email(logins: DataFrame, users: DataFrame, customers: DataFrame) -> DataFrame:
    """Logins (login_uid, email) without a user row, matched to the first customer by e-mail."""
    unknown = logins.filter("email <> ''").join(users.select("login_uid"), "login_uid", "left_anti")
    first = customers.filter("email <> ''").groupBy("email").agg(F.min("id").alias("customer_id"))
    return unknown.join(first, "email").select("login_uid", "email", "customer_id")
