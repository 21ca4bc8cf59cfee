"""Raw domain tables derived from the driver's star-schema tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cargoframe import schema as S
from cargoframe.functions.statuses import step_index
from cargoframe.functions.text import shipping_mark
from cargoframe.sources import loads
from cargoframe.sources.scratch import settle

MARK_PREFIX = "FRT-"


BASE_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the stated schema saves a footer job per read."""
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _text(column) -> F.Column:
    return F.col(column).cast("string")


def raw_customers(spark, sf_dir):
    key = F.col("c_custkey")
    number = (F.lit(240000000) + key - F.when(key % 10 == 9, 1).otherwise(0)).cast("string")
    phone = (
        F.when(key % 3 == 0, F.concat(F.lit("0"), number))
        .when(key % 3 == 1, F.concat(F.lit("+233 "), number))
        .otherwise(F.concat(F.lit("233"), number))
    )
    segment = F.col("c_mktsegment")
    package = (
        F.when(segment == "HOUSEHOLD", "standard").when(segment == "FURNITURE", "business")
        .when(segment == "MACHINERY", "premium").when(segment == "AUTOMOBILE", "special")
    )
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    return base(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        phone.alias("phone"),
        mail.alias("email"),
        F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"),
        package.alias("package_raw"),
        F.when(key % 4 == 0, "air").otherwise("sea").alias("shipping_type"),
        F.date_add(F.lit("1995-01-01").cast("date"), (key % 2400).cast("int")).alias("created_at"),
    )


def raw_containers(spark, sf_dir):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    status = (
        F.when(nation % 3 == 0, "Loading").when(nation % 3 == 1, "Shipped to Ghana")
        .otherwise("Arrived in Ghana")
    )
    eta = F.date_add(F.lit("2001-06-01").cast("date"), (key % 90).cast("int"))
    return base(spark, sf_dir, "supplier").select(
        key.alias("id"),
        F.concat(F.lit("CON-"), _text("s_suppkey")).alias("container_ref"),
        F.col("s_name").alias("name"),
        status.alias("status"),
        F.when(key % 5 != 0, eta).alias("eta"),
    )


def raw_orders(spark, sf_dir):
    status = (
        F.when(F.col("o_orderstatus") == "F", "Paid").when(F.col("o_orderstatus") == "O", "Pending")
        .otherwise("Partial")
    )
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(100).cast(S.MONEY))
    return base(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("status"),
        F.col("o_totalprice").cast(S.MONEY).alias("invoice_amount"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("invoice_date"),
        F.col("o_orderdate").alias("created_at"),
        urgent.alias("discount"),
    )


def _lines(spark, sf_dir):
    """Lines with the columns of their order and part that items take."""
    lines = base(spark, sf_dir, "lineitem").drop("l_extendedprice", "l_discount")
    orders = base(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = base(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
        parts, lines.l_partkey == parts.p_partkey
    ).drop("o_orderkey", "p_partkey")


#: Columns of the joined lines that a column of the items is made of; all need those of the id.
_MADE_OF = {
    "customer_id": ["o_custkey"], "status": ["l_returnflag", "l_linestatus"], "is_missing": ["l_tax"],
    "length": ["p_size"], "width": ["p_size"], "dimension_unit": ["p_size"], "weight": ["p_size"],
    "description": ["p_name"], "date_received": ["l_shipdate"],
}


def _items_of(joined):
    line, size = F.col("l_linenumber"), F.col("p_size")
    flags = F.concat("l_returnflag", "l_linestatus")
    status = F.lit(S.COMPLETED)
    for code, name in zip(("RF", "NO", "NF", "AO", "AF"), reversed(S.ITEM_STATUSES[:5])):
        status = F.when(flags == code, name).otherwise(status)
    key = F.concat_ws(
        "-", _text("l_orderkey"), _text("l_partkey"), _text("l_suppkey"), line.cast("string"),
        F.col("l_quantity").cast("int").cast("string"),
    )
    named = [F.col("p_name").alias("description")] if "p_name" in joined.columns else []
    return joined.select(
        key.alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(line != 7, F.col("l_orderkey")).alias("order_id"),
        F.when(line % 5 != 0, F.col("l_suppkey")).alias("container_id"),
        status.alias("status"),
        (F.col("l_tax") == 0.08).alias("is_missing"),
        F.when(line % 4 == 0, "air").otherwise("sea").alias("shipping_type"),
        F.when(size % 10 != 0, size.cast("double")).alias("length"),
        (F.lit(10) + size % 7).cast("double").alias("width"),
        F.lit(20.0).alias("height"),
        F.when(size % 2 == 0, "inches").otherwise("cm").alias("dimension_unit"),
        (size.cast("double") / 4).alias("weight"),
        F.col("l_quantity").cast("int").alias("quantity"),
        *named,
        F.when(line != 3, F.concat(F.lit("TRK"), _text("l_partkey"))).alias("tracking_number"),
        F.col("l_shipdate").alias("date_received"),
    )


def raw_items(spark, sf_dir):
    return _items_of(_lines(spark, sf_dir))


def stored_items(spark, sf_dir, *columns):
    """These columns of the items, whose joined lines are written once: for jobs that read the
    table several times, as a table is in practice. No shuffle carries what the columns do not need."""
    joined = _lines(spark, sf_dir)
    needed = {c for name in columns for c in _MADE_OF.get(name, [])}
    spare = {c for made in _MADE_OF.values() for c in made} - needed
    held = settle(joined.drop(*spare), "lines", lean=True)
    filled = held.withColumns({c: F.lit(None).cast(joined.schema[c].dataType) for c in spare if c != "p_name"})
    return loads.load_items(_items_of(filled)).select(*columns)


def raw_history(spark, sf_dir):
    event = F.col("event_type")
    status = (
        F.when(event == "signup", S.RECEIVED).when(event == "view", S.SHIPPED)
        .when(event == "click", S.ARRIVED).when(event == "error", S.SORTING).otherwise(S.READY)
    )
    return base(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("record_id"),
        status.alias("new_status"),
        F.col("ts").cast("timestamp_ntz").alias("changed_at"),
        F.col("value").alias("amount"),
    )


def raw_suppliers(spark, sf_dir):
    nation = F.col("s_nationkey")
    category = (
        F.when(nation % 4 == 0, "Electronics").when(nation % 4 == 1, "Clothing")
        .when(nation % 4 == 2, "Toys").otherwise("Other")
    )
    platform = F.when(nation % 3 == 0, "Alibaba").when(nation % 3 == 1, "Taobao").otherwise("Other")
    return base(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        category.alias("category"),
        platform.alias("platform"),
        (F.lit(1) + F.col("s_suppkey") % 5).cast("int").alias("rating"),
    )


def payments(spark, sf_dir):
    key = F.col("o_orderkey")
    paid = F.when(key % 3 == 0, 0.0).when(key % 3 == 1, 500.0).otherwise(F.col("o_totalprice"))
    return base(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(
        key.alias("order_id"),
        F.col("o_totalprice").cast(S.MONEY).alias("total_amount"),
        paid.cast(S.MONEY).alias("amount_paid"),
    )


def stored_rates(spark, sf_dir):
    """Stored price list: no basic tier, and one tier (gold) that the library does not know."""
    tiers = customers(spark, sf_dir).select(F.coalesce("package", F.lit("gold")).alias("tier"))
    counted = tiers.filter("tier <> 'basic'").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "tier", (F.lit(200.0) + F.col("n") % 250).alias("sea"), (F.lit(5.0) + F.col("n") % 7).alias("air")
    )


def settings(spark, usd_to_local=12.5):
    return spark.range(1).select(
        F.lit(usd_to_local).alias("usd_to_local"), F.lit(300.0).alias("rate_per_cbm")
    )


def special_rates(spark, sf_dir):
    """Negotiated rates, one per part type."""
    kinds = base(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return kinds.select(
        F.col("name").alias("id"), "name",
        (F.lit(100.0) + F.col("n") % 50).alias("sea"), (F.lit(2.0) + F.col("n") % 5).alias("air"),
    )


def raw_users(spark, sf_dir):
    """A login for every customer; staff accounts among them."""
    key = F.col("c_custkey")
    role = F.when(key % 50 == 0, "super_admin").when(key % 20 == 0, "warehouse_staff")
    return base(spark, sf_dir, "customer").select(
        F.concat(F.lit("U"), _text("c_custkey")).alias("id"),
        F.concat(F.lit("uid-"), _text("c_custkey")).alias("login_uid"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias(
            "email"
        ),
        role.alias("role"),
        F.when(role.isNull(), key).alias("customer_id"),
        F.when(key % 4 == 0, F.col("c_name")).alias("customer_name"),
        F.date_add(F.lit("2000-01-01").cast("date"), (key % 365).cast("int")).alias("last_login"),
    )


def raw_warehouses(spark, sf_dir):
    key = F.col("n_nationkey")
    return base(spark, sf_dir, "nation").select(
        key.alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("Dock "), _text("n_regionkey")).alias("address"),
        F.when(key % 4 == 0, False).when(key % 4 == 1, True).alias("is_active"),
        F.date_sub(F.lit("2000-12-31").cast("date"), key).alias("created_at"),
    )


def raw_registrations(spark, sf_dir):
    """Sign-up requests taken from the customer table; a third is already marked."""
    key = F.col("c_custkey")
    return base(spark, sf_dir, "customer").select(
        (key + 1000000).alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("0"), (F.lit(240000000) + key).cast("string")).alias("phone"),
        F.when(
            key % 2 == 0,
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")),
        ).otherwise(F.concat(F.lit("new"), _text("c_custkey"), F.lit("@example.com"))).alias("email"),
        F.when(key % 3 == 0, "Created").when(key % 3 == 1, "Review").alias("status"),
        F.date_add(F.lit("2001-01-01").cast("date"), (key % 200).cast("int")).alias("submitted_at"),
    )


def raw_logs(spark, sf_dir):
    """Free text that names customers and containers by record id, some of them unknown."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    details = (
        F.when(key % 4 == 0, F.lit("Signed in"))
        .when(key % 4 == 1, F.concat(F.lit("Invoice for CUS"), cust.cast("string"), F.lit(" sent")))
        .when(
            key % 4 == 2,
            F.concat(
                F.lit("Moved BOX"), (key % 150).cast("string"), F.lit(" of CUS"),
                cust.cast("string"), F.lit(", again CUS"), cust.cast("string"),
            ),
        )
        .otherwise(F.concat(F.lit("Checked BOX"), (key % 150).cast("string")))
    )
    return base(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_orderpriority").alias("action"),
        F.when(key % 5 != 0, F.concat(F.lit("staff"), (key % 7).cast("string"), F.lit("@example.com")))
        .alias("user_email"),
        details.alias("details"),
        F.col("o_orderdate").alias("timestamp"),
    )


def raw_tickets(spark, sf_dir):
    """Support threads: each source row carries its message as a JSON array."""
    sent = F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int"))
    message = F.struct(
        F.concat(F.lit("msg_"), _text("turn")).alias("id"),
        F.when(F.col("role") == "user", "customer").otherwise("admin").alias("sender"),
        F.col("text").alias("content"),
        F.concat(sent.cast("string"), F.lit("T00:00:00")).alias("timestamp"),
    )
    return base(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), F.to_json(F.array(message)).alias("messages")
    )


def customers(spark, sf_dir):
    """Loaded customers with their shipping mark."""
    loaded = loads.load_customers(raw_customers(spark, sf_dir))
    mark = shipping_mark(F.col("name"), F.col("phone"), MARK_PREFIX)
    return loaded.withColumn("shipping_mark", mark)


def items(spark, sf_dir):
    return loads.load_items(raw_items(spark, sf_dir))


def orders(spark, sf_dir):
    return loads.load_orders(raw_orders(spark, sf_dir))


def containers(spark, sf_dir):
    return loads.load_containers(raw_containers(spark, sf_dir))


def history(spark, sf_dir):
    return loads.load_status_history(raw_history(spark, sf_dir))


def item_history(spark, sf_dir):
    """Recorded steps of every item up to its present status, with gaps."""
    source = items(spark, sf_dir).select("id", "status", "date_received", "quantity")
    steps = source.select(
        "*", F.explode(F.sequence(F.lit(0), step_index(F.col("status")))).alias("step")
    ).filter((F.col("quantity") + F.col("step")) % 3 != 0)
    names = F.array(*[F.lit(s) for s in S.ITEM_STATUSES])
    return steps.select(
        F.concat_ws("/", "id", _text("step")).alias("id"),
        F.col("id").alias("record_id"),
        F.get(names, F.col("step")).alias("new_status"),
        F.date_add(F.col("date_received").cast("date"), F.col("step") * 9)
        .cast("timestamp_ntz").alias("changed_at"),
    )


def users(spark, sf_dir):
    return loads.load_users(raw_users(spark, sf_dir))


def warehouses(spark, sf_dir):
    return loads.load_warehouses(raw_warehouses(spark, sf_dir))


def suppliers(spark, sf_dir):
    return loads.load_suppliers(raw_suppliers(spark, sf_dir))


def registrations(spark, sf_dir):
    return loads.load_registrations(raw_registrations(spark, sf_dir))


def logs(spark, sf_dir):
    return loads.load_activity_logs(raw_logs(spark, sf_dir))


# Request frames for the bulk jobs ------------------------------------------------------


def _one_pass(source: DataFrame, *cases) -> DataFrame:
    """Up to one row per (condition, columns) case and source row, from a single scan."""
    made = F.array(*[F.when(condition, F.struct(F.lit(True).alias("_made"), *columns)) for condition, columns in cases])
    return source.select(F.inline(made)).filter("_made").drop("_made")


def _tagged(letter: str):
    return F.concat(F.lit(letter), "id").alias("request_id")


def _later(days: int):
    return (F.col("date_received") + F.expr(f"INTERVAL {days} DAYS")).alias("requested_at")


def status_requests(spark, sf_dir, table=None):
    """Status requests, up to four in turn per item, and some for items that do not exist."""
    source = (items(spark, sf_dir) if table is None else table).select("id", "status", "quantity", "date_received")
    names = F.array(*[F.lit(s) for s in S.ITEM_STATUSES])
    q = F.col("quantity")

    def case(letter, item_id, status, role, actor, days):
        return [
            _tagged(letter), item_id.alias("item_id"), status.alias("new_status"),
            role.alias("role"), actor.alias("actor"), _later(days),
            F.lit(None).cast("string").alias("notes"),
        ]

    wanted = F.get(names, (step_index(F.col("status")) + q) % 6)
    role = F.when(q % 2 == 0, "warehouse_staff").otherwise("super_admin")
    actor = F.when(q % 3 == 0, "desk").otherwise("ops@example.com")
    done = (F.lit(S.COMPLETED), F.lit("super_admin"), F.lit("ops@example.com"))
    following = F.get(names, (step_index(F.col("status")) + 1) % 6)
    opposite = F.get(names, (step_index(F.col("status")) + q + 3) % 6)
    return _one_pass(
        source,
        (q % 4 != 0, case("P", F.col("id"), following, F.lit("warehouse_staff"), actor, 75)),
        (q % 3 == 1, case("S", F.col("id"), opposite, role, actor, 125)),
        (q % 5 != 0, case("R", F.col("id"), wanted, role, actor, 100)),
        (q % 7 == 0, case("Q", F.col("id"), *done, 50)),
        (q % 11 == 0, case("X", F.concat("id", F.lit("?")), *done, 0)),
    )


def load_requests(spark, sf_dir):
    """Loading requests, some for unknown items or containers, some in conflict."""
    size = containers(spark, sf_dir).agg((F.count(F.lit(1)) + 2).alias("_boxes"))
    source = items(spark, sf_dir).select("id", "quantity", "container_id", "date_received")
    q = F.col("quantity")

    def case(letter, item_id, box, days):
        return [
            _tagged(letter), item_id.alias("item_id"),
            box.cast("bigint").alias("container_id"), _later(days),
        ]

    return _one_pass(
        source.crossJoin(F.broadcast(size)),
        (q % 2 == 0, case("A", F.col("id"), (q * 7) % F.col("_boxes"), 0)),
        (q % 3 == 0, case("B", F.col("id"), F.coalesce("container_id", F.lit(3)), 1)),
        (q % 11 == 0, case("X", F.concat("id", F.lit("?")), F.lit(1), 0)),
    )


def sorting_actions(spark, sf_dir):
    source = items(spark, sf_dir).select("id", "status", "is_missing", "quantity", "date_received")
    q = F.col("quantity")
    kind = F.when(q % 3 == 0, "found").when(q % 3 == 1, "missing").otherwise("lost")

    def case(letter, action, days):
        return [
            _tagged(letter), F.col("id").alias("item_id"), action.alias("action"),
            F.lit("super_admin").alias("role"), F.lit("ops@example.com").alias("actor"),
            _later(days),
        ]

    return _one_pass(
        source,
        ((F.col("status") == S.SORTING) | F.col("is_missing"), case("R", kind, 100)),
        (q % 7 == 0, case("Q", F.lit("missing"), 50)),
    )


def box_requests(spark, sf_dir):
    """Up to two requests in turn per container, some for containers that do not exist."""
    key = F.col("id")
    status = (
        F.when(key % 3 == 0, "Shipped to Ghana").when(key % 3 == 1, "Arrived in Ghana")
        .otherwise("Loading")
    )
    arrival = F.date_add(F.lit("2001-07-01").cast("date"), (key % 30).cast("int"))

    def asked(letter, condition, box, new_status, arrival_date, day):
        return containers(spark, sf_dir).filter(condition).select(
            F.concat(F.lit(letter), _text("id")).alias("request_id"), box.alias("container_id"),
            new_status.alias("new_status"), arrival_date.alias("arrival_date"),
            F.lit(day).cast("timestamp_ntz").alias("requested_at"))

    dated = F.when(key % 2 == 0, arrival.cast("timestamp_ntz"))
    none = F.lit(None).cast("timestamp_ntz")
    return (
        asked("C", key % 4 != 3, key, status, dated, "2001-07-02")
        .unionByName(asked("D", key % 5 < 2, key, F.lit("Loading"), none, "2001-07-03"))
        .unionByName(asked("B", key % 3 == 1, key, F.lit("Shipped to Ghana"), arrival.cast("timestamp_ntz"), "2001-07-01"))
        .unionByName(asked("X", key % 7 == 0, -key - 1, status, dated, "2001-07-02"))
    )


def sold_orders(spark, sf_dir):
    """Orders of which every second one has an invoice with the payment service."""
    key = F.col("id")
    quarter = key % 4 == 0
    return orders(spark, sf_dir).withColumns(
        {
            "sale_id": F.when(key % 2 == 0, F.concat(F.lit("S"), _text("id"))),
            "amount_paid": F.when(quarter, F.lit(50).cast(S.MONEY)),
            "balance_due": F.when(quarter, (F.col("invoice_amount") - 50).cast(S.MONEY)),
        }
    )


def snapshot_payloads(spark, sf_dir):
    """Payment service replies as JSON: three spellings, one in ten without a total."""
    key = F.col("order_id")
    total, paid = F.col("total_amount").cast("string"), F.col("amount_paid").cast("string")
    flat = F.to_json(F.struct(total.alias("total_amount"), paid.alias("amount_paid")))
    nested = F.to_json(
        F.struct(F.struct(total.alias("grand_total"), paid.alias("paid")).alias("data"))
    )
    broken = F.to_json(F.struct(paid.alias("amount_received")))
    payload = F.when(key % 10 == 0, broken).when(key % 4 == 0, nested).otherwise(flat)
    return payments(spark, sf_dir).filter(key % 2 == 0).select(
        F.concat(F.lit("S"), _text("order_id")).alias("sale_id"), payload.alias("payload")
    )
