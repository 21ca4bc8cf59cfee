"""Hot and cold paths give the same rows; plans stay free of needless shuffles."""

import random

import pytest
from pyspark.sql import Window, functions as F

from cargoframe.operators import pricing, skew, throttle, windows
from cargoframe.sources import fixtures as X
from cargoframe.streaming import feeds
from tests.conftest import rows, same


def plan(df):
    return df._jdf.queryExecution().toString()


def test_hot_keys_are_found(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    assert rows(skew.hot_keys(df, ["k"], 100)) == [(0,)]
    cold, hot = skew.split_hot(df.unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS k")), ["k"], 100)
    assert (cold.count(), hot.count()) == (601, 400)


def test_numbering_across_ranges(spark):
    df = spark.range(5000).select(F.expr("pmod(id * 7919, 5000)").alias("v"))
    got = skew.number_rows(df, [("v", "asc")])
    assert got.filter("row_no <> v + 1").isEmpty() and got.count() == 5000
    grouped = df.withColumn("g", F.when(F.col("v") < 2000, 0).otherwise(F.col("v") % 50))
    grouped = grouped.withColumn("g", F.when(F.col("g") != 7, F.col("g")))  # one group is NULL
    for way in ("asc", "desc"):
        plain = Window.partitionBy("g").orderBy(skew.order_by([("v", way)])[0])
        want = grouped.withColumn("row_no", F.row_number().over(plain).cast("bigint"))
        got = skew.number_in_groups(grouped, ["g"], [("v", way)])
        assert same(got, want)
    windows = [line for line in plan(got).split("\n") if "Window [" in line and "row_number" in line]
    assert windows and all("_range" in line for line in windows)  # no window gathers a whole group


def test_state_before_each_row(spark):
    """Segmented running maxima against a plain loop; one group holds a third of the rows."""
    random.seed(4)
    data = [(0 if random.random() < 0.35 else random.randrange(1, 40), n, random.randrange(100),
             random.random() < 0.002 * (1 + n % 3), random.random() < 0.2) for n in range(3000)]
    df = spark.createDataFrame(data, "g int, at int, v int, opens boolean, skip boolean")
    value = F.when(~F.col("skip") | F.col("opens"), F.col("v"))
    got = {r["at"]: r["before"] for r in skew.running_before(
        df, ["g"], [("at", "asc")], value, F.col("opens"), F.lit(50), "before").collect()}
    state = {}
    for g, at, v, opens, skip in data:
        assert got[at] == state.get(g, 50)
        if opens:
            state[g] = v
        elif not skip:
            state[g] = max(state.get(g, 50), v)


def test_join_unique(spark):
    left = spark.range(300).select("id", F.when(F.col("id") < 100, 1).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 300, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    right = right.unionByName(spark.sql("SELECT 1L AS k, 5L AS w"))
    for how in ("inner", "left"):
        assert same(skew.join_unique(left, right, ["k"], how, 50), left.join(right, ["k"], how))


@pytest.mark.parametrize("share", ["cbm", "quote"])
def test_invoice_split_is_exact_for_a_hot_order(spark, sf, share):
    """One order holds a third of all items; partition counts do not move a cent."""
    orders, settings = X.orders(spark, sf), X.settings(spark)
    open_order = orders.filter("status <> 'Paid'").agg(F.min("id")).first()[0]
    items = X.items(spark, sf).withColumn(
        "order_id", F.when(F.crc32(F.col("id").cast("string")) % 3 == 0, F.lit(open_order)).otherwise(F.col("order_id")))
    quoted = items.select(F.col("id").alias("item_id"), F.col("weight").alias("price"))

    def split(parts):
        some = items.repartition(parts)
        made = pricing.invoice_lines(orders, some, settings) if share == "cbm" else \
            pricing.invoice_lines_quoted(orders, some, quoted, settings)
        return made.cache()

    base = split(3)
    assert same(base, split(11))
    net = pricing._order_heads(orders, settings)
    sums = base.groupBy("order_id").agg(F.sum("price").alias("s"))
    assert net.join(sums, "order_id").filter(F.abs(F.col("net") - F.col("s")) > 0.004).isEmpty()
    assert sums.count() == net.count()


def brute_force(events, limit, length):
    out, state = {}, {}
    for us, key, number in sorted((e[2], e[1], e[0]) for e in events):
        ends, taken = state.get(key, (None, 0))
        if ends is None or us > ends:
            ends, taken = us + length, 0
        out[number] = taken < limit
        state[key] = (ends, taken + out[number])
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 200])
def test_rate_limit_equals_brute_force(spark, hot_rows):
    dice = random.Random(5)
    second = 1_000_000
    events = [(0, 7, 0), (1, 7, 60 * second), (2, 7, 60 * second + 1), (3, 7, 120 * second + 1)]
    for number in range(4, 900):
        key = 1 if dice.random() < 0.4 else dice.randrange(2, 30)
        events.append((number, key, dice.randrange(0, 3600) * second // dice.choice((1, 3))))
    df = spark.createDataFrame(events, "id bigint, key bigint, us bigint").select(
        "id", "key", F.timestamp_micros("us").cast("timestamp_ntz").alias("at"))
    for limit in (3,):
        got = throttle.rate_limit_labels(df, limit, 60, hot_rows)
        assert {r["id"]: r["allowed"] for r in got.collect()} == brute_force(events, limit, 60 * second)


def test_status_changes_on_hot_records(spark, sf):
    history = X.history(spark, sf)
    assert same(feeds.status_changes(history), feeds.status_changes(history, hot_rows=1))


def test_dedupe_limits_before_the_shuffle(spark, sf):
    text = plan(windows.dedupe_tracking(X.items(spark, sf)))
    partial = text.index("row_number(), 1, Partial")
    assert text.index("row_number(), 1, Final") < partial


def test_no_cartesian_products(spark, sf):
    from __spark_entry__ import queries

    for name in ("d6_customer_analytics", "j4_invoice_lines", "k2_item_timeline", "i1_apply_item_status",
                 "c4_container_manifest", "b16_match_customers"):
        assert "CartesianProduct" not in plan(queries()[name](spark, sf))


def test_filters_and_columns_reach_the_scan(spark, sf):
    from __spark_entry__ import queries

    text = plan(queries()["a13_scan_table"](spark, sf))
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThan(o_totalprice,200000.0)" in text
    text = plan(queries()["d3_monthly_revenue"](spark, sf))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_report_aggregates_before_joining(spark, sf):
    from __spark_entry__ import queries

    physical = plan(queries()["d6_customer_analytics"](spark, sf)).split("== Physical Plan ==")[1]
    join = physical.index("Join")
    assert "partial_count" not in physical[:join] and "partial_count" in physical[join:]


def test_no_window_gathers_a_rate_limited_key(spark):
    events = spark.range(400).select("id", F.lit(1).alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("at"))
    timed = events.select("key", F.unix_micros("at").alias("us"))
    found = plan(throttle._successors(timed, 3_600_000_000))
    windows = [line for line in found.split("\n") if "Window [" in line]
    assert windows and all("cell" in line or "_range" in line for line in windows)


def test_a_full_container_can_be_split(spark, sf):
    """Above the join of containers and items stands an exchange, so nothing needs its partitioning."""
    from cargoframe.operators import links

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = links.container_manifest(X.containers(spark, sf), X.items(spark, sf), X.customers(spark, sf))
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(n for n, line in enumerate(lines) if "SortMergeJoin [container_id" in line)
    above = [line for line in lines[:at] if "Exchange" in line or "Aggregate" in line]
    assert above and "Exchange" in above[-1] and not any("Aggregate" in line for line in above)


def test_windows_keep_their_length_over_a_clock_shift(spark):
    """25 hours lie between the two events on the clock of the column, whatever the session's zone does."""
    rows_ = spark.sql("SELECT 1L AS id, 'k' AS key, TIMESTAMP_NTZ'2024-03-09 12:00:00' AS at "
                      "UNION ALL SELECT 2L, 'k', TIMESTAMP_NTZ'2024-03-10 12:30:00'")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = rows(throttle.rate_limit_labels(rows_, 1, 86_400), "id", "allowed")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(1, True), (2, True)]
