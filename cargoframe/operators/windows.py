"""Ranking, numbering and remainder allocation."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from cargoframe.functions.measures import cents
from cargoframe.functions.text import reference
from cargoframe.operators.skew import Order, number_in_groups, number_rows
from cargoframe.schema import MONEY
from cargoframe.sources.scratch import settle


def dedupe_tracking(items: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """The latest received item per tracking number; items without a number are all kept.

    The rank filter is applied before the shuffle as well, so a number that many rows
    share sends one row per task; items without a number get a group of their own.
    """
    number = F.col("tracking_number")
    blank = F.coalesce(F.trim(number) == "", F.lit(True))
    own_group = F.when(blank, F.col("id"))
    tagged = items.select(
        "*", F.when(~blank, number).alias("_number"), own_group.alias("_own")
    )
    latest = Window.partitionBy(*within, "_number", "_own").orderBy(
        F.desc_nulls_last("date_received"), "id"
    )
    ranked = tagged.withColumn("_rank", F.row_number().over(latest))
    return ranked.filter("_rank = 1").drop("_rank", "_number", "_own")


def assign_refs(
    new_rows: DataFrame, existing: DataFrame, prefix: str, width: int, order: Order, ref: str = "ref",
) -> DataFrame:
    """Continue the sequence after the highest existing reference with this prefix."""
    tail = F.regexp_extract(F.col(ref), r"(\d+)$", 1).try_cast("bigint")
    last = existing.filter(F.col(ref).startswith(prefix)).agg(
        F.coalesce(F.max(tail), F.lit(0)).alias("_last")
    )
    numbered = number_rows(new_rows, order, "_no").crossJoin(F.broadcast(last))
    return numbered.withColumn(
        ref, reference(prefix, F.col("_last") + F.col("_no"), width)
    ).drop("_no", "_last")


def invoice_line_no(lines: DataFrame, order: Order, key: str = "order_id") -> DataFrame:
    return number_in_groups(lines, [key], order, "line_no")


def ranked_customers(top_customers: DataFrame, value: str = "revenue") -> DataFrame:
    """Rank and percent of the leader; the input is a report of at most n rows."""
    best = Window.orderBy(F.desc(value), "customer_id")
    leader = F.max(value).over(Window.partitionBy())
    share = F.when(leader != 0, F.col(value).cast("double") / leader.cast("double") * 100)
    return top_customers.select(
        "*", F.row_number().over(best).alias("rank"), share.alias("pct_of_leader")
    )


def share_of_max(monthly: DataFrame, value: str) -> DataFrame:
    """Percent of the peak month (peak at least 1), at least 4 when there is any value."""
    peak = F.greatest(F.max(F.col(value).cast("double")).over(Window.partitionBy()), F.lit(1.0))
    percent = F.col(value).cast("double") / peak * 100
    floor = F.when(F.col(value) > 0, 4.0).otherwise(0.0)
    return monthly.select("*", F.greatest(percent, floor).alias("pct_of_peak"))


def share_units(share: Column) -> Column:
    """A share in whole billionths (up to 9.2e9): their sum does not depend on the order of addition."""
    return F.floor(share * F.lit(1e9) + F.lit(0.5)).cast("bigint")


def units_total(units) -> Column:
    return F.sum(F.col(units).cast("decimal(20,0)"))


def group_totals(lines: DataFrame, order_cols: list[str], key: str) -> DataFrame:
    """What ``split_to_cents`` needs of a group, by partial aggregation over ``_units``."""
    return lines.groupBy(key).agg(
        units_total("_units").alias("_total"), F.count(F.lit(1)).alias("_n"),
        F.max(F.struct(*order_cols)).alias("_end"),
    )


def split_to_cents(rows: DataFrame, net: str, order_cols: list[str], key: str, out: str, keep: bool = False) -> DataFrame:
    """Allocation over rows that carry ``_units`` and their group's ``_total``, ``_n`` and ``_end``.

    The priced rows are used three times; with ``keep`` they are written once, for rows that cost much to make.

    Only one row per group, the last line, is joined to what the other lines were given. The
    key is wrapped for that sum, so it gets a shuffle of its own after the partial sums and
    adaptive execution stays free to split a hot group in the join below.
    """
    part = F.when(
        F.col("_total") > 0, F.col("_units").cast("double") / F.col("_total").cast("double")
    ).otherwise(F.lit(1.0) / F.coalesce("_n", F.lit(1)))
    last = F.col("_end").isNull() | F.struct(*order_cols).eqNullSafe(F.col("_end"))
    kept = [c for c in rows.columns if c not in ("_units", "_total", "_n", "_end")]
    priced = rows.select(
        *kept, last.alias("_last"), cents(F.col(net).cast("double") * part).alias(out)
    )
    if keep:
        priced = settle(priced, "priced", lean=True)
    others = priced.filter("NOT _last")
    given = others.groupBy(F.struct(key).alias("_group")).agg(F.sum(out).alias("_given"))
    ends = priced.filter("_last").withColumn("_of", F.struct(key)).drop(out)
    left = cents(F.col(net)) - F.coalesce("_given", F.lit(0).cast(MONEY))
    closed = ends.join(given, F.col("_of") == F.col("_group"), "left").select(
        *kept, left.cast(MONEY).alias(out)
    )
    return others.drop("_last").unionByName(closed)


def running_split(
    lines: DataFrame, net: str, share: str, order_cols: list[str], key: str = "order_id",
    out: str = "price",
) -> DataFrame:
    """Split ``net`` over the lines of a group to the cent.

    Every line but the last gets its rounded share (an equal one if the shares add up to
    nothing); the last line in ``order_cols`` gets what is left. A NULL key is a group.
    """
    rows = lines.withColumn("_units", share_units(F.col(share)))
    totals = group_totals(rows, order_cols, key).withColumnRenamed(key, "_key")
    rows = rows.join(totals, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return split_to_cents(rows, net, order_cols, key, out)
