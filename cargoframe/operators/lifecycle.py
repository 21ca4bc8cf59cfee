"""Set-based status, loading, payment and intake jobs.

A job takes the current tables and a frame of requests and returns the new table with
what was accepted, what was rejected and why, and the history rows to append. Requests for
one record take effect one after the other, by ``requested_at`` and ``request_id`` (unique).
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from cargoframe.functions.statuses import mapped, sale_amounts, step_index
from cargoframe.functions.text import (
    actor_email, blank_to_null, phone_key, shipping_address, shipping_mark,
)
from cargoframe.operators.skew import (
    HOT_ROWS, cut_groups, durable, for_pieces, join_unique, piece_keys, running_before, running_in_pieces,
    with_pieces,
)
from cargoframe.operators.windows import assign_refs
from cargoframe.schema import (
    CLEARS_MISSING, ITEM_STATUSES, ITEM_STATUS_FOR_CONTAINER, MONEY, READY, SHIPPED, UNPAID,
)
from cargoframe.sources.tables import delete_rows, upsert_rows


class Change(NamedTuple):
    table: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    history: DataFrame


#: Columns of an item that its changes show; those that a table lacks are NULL.
ITEM_DETAILS = ("item_ref", "customer_id", "order_id", "tracking_number", "description", "is_missing")
#: The order in which requests for one record take effect.
IN_TURN = [("requested_at", "asc"), ("request_id", "asc")]


def history_rows(changes: DataFrame, record_type: str = "Item") -> DataFrame:
    """Status history of accepted changes; the actor is kept only if it is an e-mail."""
    return changes.select(
        F.lit(record_type).alias("record_type"),
        F.col("id").alias("record_id"),
        F.col("item_ref").alias("record_ref"),
        "previous_status",
        "new_status",
        actor_email(F.col("actor")).alias("changed_by"),
        F.col("role").alias("changed_by_role"),
        F.col("requested_at").alias("changed_at"),
        F.coalesce("request_notes", F.lit("")).alias("notes"),
    )


def _rejections(*parts: tuple[DataFrame, Column | str]) -> DataFrame:
    result = None
    for df, reason in parts:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        rows = df.select("request_id", F.col("item_id").cast("string"), reason.alias("reason"))
        result = rows if result is None else result.unionByName(rows)
    return result


def judge_item_status(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request with the item it names, the status it meets and ``reason`` (NULL: accepted).

    Only an accepted request changes the status: of an admin always, of staff if the step is not
    below the one it meets, to shipped only with a container. So the status before a request is
    the greatest step since the last valid admin request, or since the stored status.
    """
    stored, step = step_index(F.col("status")), step_index(F.col("new_status"))
    # known statuses travel as steps
    side = items.select(
        F.col("id").alias("item_id"), F.lit(True).alias("_known"), stored.alias("_stored"),
        F.when(stored < 0, F.col("status")).alias("_stored_name"), F.col("container_id").isNull().alias("_loose"),
        *[F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in ITEM_DETAILS],
    )
    asked = requests.select(
        "request_id", "item_id", step.alias("_step"), F.when(step < 0, F.col("new_status")).alias("_name"),
        F.coalesce(F.col("role") == "warehouse_staff", F.lit(False)).alias("_staff"), "role", "actor",
        "requested_at", F.col("notes").alias("request_notes"),
    )
    # requests and items are dealt out by the same pieces, over which the windows run as well
    cuts = cut_groups(requests, ["item_id"], IN_TURN)
    asked = with_pieces(asked, ["item_id"], IN_TURN, cuts).join(
        for_pieces(side, ["item_id"], cuts), piece_keys(["item_id"], cuts), "left")
    step, staff = F.col("_step"), F.col("_staff")
    no_container = (step == ITEM_STATUSES.index(SHIPPED)) & F.col("_loose")
    valid = F.col("_known") & (step >= 0) & ~F.coalesce(no_container, F.lit(False))
    met = running_in_pieces(
        asked, ["item_id"], IN_TURN, F.when(valid, step), valid & ~staff,
        F.coalesce("_stored", F.lit(-1)), "_met", cuts,
    )
    backward = staff & (step < F.col("_met"))
    names = F.array(*[F.lit(s) for s in ITEM_STATUSES])
    previous = F.when(F.col("_met") >= 0, F.get(names, F.col("_met"))).otherwise(F.col("_stored_name"))
    reason = F.when(F.col("_known").isNull(), "unknown item").when(step < 0, "unknown status").when(
        backward, "status can only move forward"
    ).when(no_container, "no container")
    return met.select(
        "item_id", "request_id", F.when(step >= 0, F.get(names, step)).otherwise(F.col("_name")).alias("new_status"),
        "role", "actor", "requested_at", "request_notes", *ITEM_DETAILS, previous.alias("previous_status"),
        reason.alias("reason"))


def _accepted(judged: DataFrame) -> DataFrame:
    return judged.filter("reason IS NULL").withColumn("id", F.col("item_id"))


def moved_items(items: DataFrame, judged: DataFrame, how: str = "inner") -> DataFrame:
    """The items that accepted requests name, with the status they end in (``left``: all items)."""
    last = F.max(F.struct("requested_at", "request_id", "new_status")).alias("_last")
    ends = _accepted(judged).groupBy("id").agg(
        last, F.bool_or(F.col("new_status").isin(*CLEARS_MISSING)).alias("_cleared"))
    return items.join(ends, "id", how).withColumns(
        {
            "status": F.coalesce("_last.new_status", "status"),
            "is_missing": F.when(F.col("_cleared"), False).otherwise(F.col("is_missing")),
        }
    ).select(items.columns)


def ended_items(judged: DataFrame) -> DataFrame:
    """id, status and is_missing of the items that accepted requests name, from the judged requests alone."""
    taken = F.col("reason").isNull()
    ends = judged.groupBy(F.col("item_id").alias("id")).agg(
        F.max(F.when(taken, F.struct("requested_at", "request_id", "new_status"))).alias("_last"),
        F.bool_or(taken & F.col("new_status").isin(*CLEARS_MISSING)).alias("_cleared"), F.max("is_missing").alias("_missing"))
    return ends.filter("_last IS NOT NULL").select(
        "id", F.col("_last.new_status").alias("status"), F.when(F.col("_cleared"), False).otherwise(F.col("_missing")).alias("is_missing"))


def apply_judged_status(items: DataFrame, judged: DataFrame) -> Change:
    table = moved_items(items, judged, "left")
    accepted = _accepted(judged).select(
        "request_id", "id", "item_ref", "customer_id", "order_id", "tracking_number",
        "description", "previous_status", "new_status", "role", "actor", "requested_at",
        "request_notes",
    )
    rejected = _rejections((judged.filter("reason IS NOT NULL"), F.col("reason")))
    return Change(table, accepted, rejected, history_rows(accepted))


def apply_item_status(items: DataFrame, requests: DataFrame) -> Change:
    """Requests: request_id, item_id, new_status, role, actor, requested_at, notes."""
    return apply_judged_status(items, judge_item_status(items, requests))


class Cascade(NamedTuple):
    containers: DataFrame
    items: DataFrame
    history: DataFrame | None
    rejected: DataFrame


def cascade_container_status(
    containers: DataFrame, items: DataFrame, requests: DataFrame, log_history: bool = False
) -> Cascade:
    """Requests: request_id, container_id, new_status, arrival_date, requested_at.

    A container ends in the status of its last request and keeps the last arrival date given.
    Items follow every request in turn (shipped -> shipped, arrived -> sorting); Loading leaves
    them where the request before has put them.
    """
    known = containers.select(F.col("id").alias("container_id"))
    asked = requests.join(known, "container_id", "left_semi").withColumn(
        "_target", mapped(F.col("new_status"), ITEM_STATUS_FOR_CONTAINER))
    turn = [F.col(c) for c, _ in IN_TURN]

    def newest(value: str) -> Column:
        """The last value that is set."""
        return F.max(F.when(F.col(value).isNotNull(), F.struct(*turn, F.col(value).alias("v"))))["v"]

    ends = asked.groupBy("container_id").agg(
        newest("new_status").alias("_status"), newest("arrival_date").alias("_arrival"),
        newest("_target").alias("_target"))
    boxes = containers.join(ends.withColumnRenamed("container_id", "id"), "id", "left").withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "arrival_date": F.coalesce("_arrival", "arrival_date"),
        }
    ).select(containers.columns)
    moved = items.join(ends.select("container_id", "_target"), "container_id", "left")
    table = moved.withColumn("status", F.coalesce("_target", "status")).select(items.columns)
    history = None
    if log_history:
        moves = asked.filter("_target IS NOT NULL").select("container_id", "_target", *turn)
        moves = running_before(
            moves, ["container_id"], IN_TURN, F.col("_target"), F.lit(True),
            F.lit(None).cast("string"), "_previous")
        steps = items.join(moves, "container_id").select(
            "id", "item_ref", F.coalesce("_previous", "status").alias("previous_status"),
            F.col("_target").alias("new_status"), F.lit(None).cast("string").alias("actor"),
            F.lit("super_admin").alias("role"), "requested_at",
            F.lit("container status").alias("request_notes"),
        )
        history = history_rows(steps)
    strangers = requests.join(known, "container_id", "left_anti").select(
        "request_id", F.col("container_id").cast("string"), F.lit("unknown container").alias("reason"))
    return Cascade(boxes, table, history, strangers)


def sync_container_items(containers: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items set to the status their container implies, updated count per container)."""
    target = mapped(F.col("status"), ITEM_STATUS_FOR_CONTAINER)
    boxes = containers.select(F.col("id").alias("container_id"), target.alias("target_status"))
    table = (
        items.join(boxes, "container_id", "left")
        .withColumn("status", F.coalesce("target_status", "status"))
        .select(items.columns)
    )
    loaded = items.filter(F.col("container_id").isNotNull()).groupBy("container_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    updated = F.when(F.col("target_status").isNotNull(), F.coalesce("_n", F.lit(0))).otherwise(0)
    counts = boxes.join(loaded, "container_id", "left").select(
        "container_id", "target_status", updated.cast("bigint").alias("updated")
    )
    return table, counts


class Loading(NamedTuple):
    table: DataFrame
    accepted: DataFrame
    rejected: DataFrame


def load_items_to_container(
    items: DataFrame, containers: DataFrame, requests: DataFrame, hot_rows: int = HOT_ROWS
) -> Loading:
    """Requests: request_id, item_id, container_id, requested_at.

    The first valid request wins; asking again for the same container is accepted.
    """
    boxes = containers.select(F.col("id").alias("container_id"))
    valid = requests.join(boxes, "container_id", "left_semi")
    no_box = requests.join(boxes, "container_id", "left_anti")
    first = valid.groupBy(F.col("item_id").alias("id")).agg(
        F.min(F.struct("requested_at", "request_id", "container_id")).alias("_first")
    ).select("id", F.col("_first.container_id").alias("_asked"))
    joined = items.join(first, "id", "left")
    placed = joined.withColumn("container_id", F.coalesce("container_id", "_asked"))
    where = placed.filter("_asked IS NOT NULL").select(
        F.col("id").alias("item_id"), F.col("container_id").alias("_in")
    )
    checked = join_unique(valid, where, ["item_id"], "left", hot_rows)
    fits = F.coalesce(F.col("_in") == F.col("container_id"), F.lit(False))
    reason = F.when(F.col("_in").isNull(), "unknown item").otherwise("in another container")
    return Loading(
        placed.select(items.columns),
        checked.filter(fits).select(requests.columns),
        _rejections((checked.filter(~fits), reason), (no_box, "unknown container")),
    )


def _flag(df: DataFrame, ids: DataFrame, key: str, name: str = "_flag") -> DataFrame:
    marks = ids.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(marks, key, "left")


def unknown_requests(requests: DataFrame, table: DataFrame, key: str, reason: str) -> DataFrame:
    """Requests whose ``key`` names no row of the table, with the reason; the jobs leave them out."""
    known = table.select(F.col("id").alias(key))
    return requests.join(known, key, "left_anti").withColumn("reason", F.lit(reason))


def unload_items(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests: item_id. The items leave whatever container they are in."""
    flagged = _flag(items, requests.withColumn("id", F.col("item_id")), "id")
    kept = F.when(F.col("_flag").isNull(), F.col("container_id"))
    return flagged.withColumn("container_id", kept).select(items.columns)


def mark_sorting(items: DataFrame, actions: DataFrame) -> Change:
    """Actions: request_id, item_id, action (found or missing), role, actor, requested_at.

    Every valid action sets or clears the missing flag in its turn; from the first find on an
    item is ready for pickup.
    """
    turn = F.struct(*[c for c, _ in IN_TURN])
    found, valid = F.col("action") == "found", F.col("action").isin("found", "missing")
    ends = actions.filter(valid).groupBy(F.col("item_id").alias("id")).agg(
        F.min(F.when(found, turn)).alias("_found"),
        F.max(F.struct(*[c for c, _ in IN_TURN], "action"))["action"].alias("_last"))
    joined = items.join(ends, "id", "left")
    table = joined.withColumns(
        {
            "status": F.when(F.col("_found").isNotNull(), READY).otherwise(F.col("status")),
            "is_missing": F.when(F.col("_last").isNotNull(), F.col("_last") == "missing")
            .otherwise(F.col("is_missing")),
        }
    ).select(items.columns)
    side = joined.select(
        F.col("id").alias("item_id"), F.col("status").alias("_stored"), "_found", "item_ref",
        "customer_id", "order_id", "tracking_number", "description")
    judged = actions.join(side.withColumn("_known", F.lit(True)), "item_id", "left")
    before = F.when(F.col("_found") < turn, READY).otherwise(F.col("_stored"))
    accepted = judged.filter(F.col("_known") & valid).select(
        "request_id", F.col("item_id").alias("id"), "item_ref", "customer_id", "order_id",
        "tracking_number", "description", before.alias("previous_status"),
        F.when(found, READY).otherwise(before).alias("new_status"), "action", "role", "actor",
        "requested_at", F.lit("Item found during sorting").alias("request_notes"),  # fixed value
    )
    reason = F.when(F.col("_known").isNull(), "unknown item").otherwise("unknown action")
    refused = judged.filter(F.col("_known").isNull() | ~F.coalesce(valid, F.lit(False)))
    return Change(table, accepted, _rejections((refused, reason)),
                  history_rows(accepted.filter("action = 'found'")))


def delete_cascade(tables: dict[str, DataFrame], kind: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete records and unlink what points to them; returns the changed tables.

    Deleting a customer removes its logins but keeps its items and orders.
    """
    ids = ids.select("id")
    changed = {f"{kind}s": delete_rows(tables[f"{kind}s"], ids)}
    if kind in ("container", "order"):
        items, link = tables["items"], f"{kind}_id"
        # one pass over the items. The key is wrapped, so the join shuffles the ids once more and
        # adaptive execution stays free to split a hot or NULL link
        gone = ids.groupBy(F.struct("id").alias("_id")).agg(F.lit(True).alias("_gone")).select(
            F.col("_id.id").alias(link), "_gone")
        left = F.when(F.col("_gone").isNull(), F.col(link))
        changed["items"] = items.join(gone, link, "left").withColumn(link, left).select(items.columns)
    elif kind == "customer":
        gone = ids.withColumn("customer_id", F.col("id"))
        changed["users"] = delete_rows(tables["users"], gone, "customer_id")
    elif kind == "item":
        for name in ("containers", "orders"):
            if "item_ids" in tables.get(name, ids).columns:
                changed[name] = _without_items(tables[name], ids)
    return changed


def _without_items(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Take deleted ids out of link arrays; only rows that hold one are rebuilt."""
    links = df.select(F.col("id").alias("_owner"), F.explode("item_ids").alias("id"))
    doomed = links.join(ids, links["id"] == ids["id"].cast("string"), "left_semi").distinct()
    lost = doomed.groupBy(F.col("_owner").alias("id")).agg(F.collect_list("id").alias("_lost"))
    kept = F.when(F.col("_lost").isNull(), F.col("item_ids")).otherwise(
        F.array_except("item_ids", "_lost")
    )
    return df.join(lost, "id", "left").withColumn("item_ids", kept).select(df.columns)


def apply_payments(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments: order_id, amount. Amounts of an order are summed, which equals applying
    them one after the other."""
    sums = payments.groupBy(F.col("order_id").alias("id")).agg(F.sum("amount").alias("_sum"))
    joined = orders.join(sums, "id", "left")
    paid_now = F.col("_sum").isNotNull()
    paid = (F.coalesce("amount_paid", F.lit(0)) + F.col("_sum")).cast(MONEY)
    due = F.greatest(F.lit(0).cast(MONEY), (F.col("invoice_amount") - paid).cast(MONEY))
    status = F.when(paid >= F.col("invoice_amount"), "Paid").otherwise("Partial")
    return joined.withColumns(
        {
            "amount_paid": F.when(paid_now, paid).otherwise(F.col("amount_paid")),
            "balance_due": F.when(paid_now, due).otherwise(F.col("balance_due")),
            "status": F.when(paid_now, status).otherwise(F.col("status")),
        }
    ).select(orders.columns)


def parse_snapshots(raw: DataFrame) -> DataFrame:
    """Raw: sale_id, payload (JSON). A snapshot without a total is unusable: all NULL."""
    total, paid, balance = sale_amounts(F.col("payload"))
    usable = F.col("total_amount").isNotNull()
    return raw.select(
        "sale_id", total.alias("total_amount"), paid.alias("_paid"), balance.alias("_balance")
    ).select(
        "sale_id", "total_amount",
        F.when(usable, F.col("_paid")).alias("sale_paid"),
        F.when(usable, F.col("_balance")).alias("sale_balance"),
    )


def sync_payment_status(orders: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders with the status of their sale snapshot, counts synced / updated / errors).

    Snapshots: sale_id (unique), total_amount, sale_paid, sale_balance.
    """
    joined = orders.join(snapshots, "sale_id", "left")
    wanted = F.col("sale_id").isNotNull() & F.col("status").isin(*UNPAID)
    usable = wanted & F.col("total_amount").isNotNull()
    new = F.when(usable & (F.col("sale_balance") <= 0), "Paid").when(
        usable & (F.col("sale_paid") > 0), "Partial"
    )
    joined = joined.withColumn("_new", new)
    counts = joined.agg(
        F.count_if(wanted).alias("synced"),
        F.count_if(F.col("_new") != F.col("status")).alias("updated"),
        F.count_if(wanted & F.col("total_amount").isNull()).alias("errors"),
    )
    table = joined.withColumn("status", F.coalesce("_new", "status")).select(orders.columns)
    return table, counts


def payment_position(orders: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Total, paid and balance shown for each order: stored, else sale, else by status."""
    joined = orders.join(snapshots, "sale_id", "left")
    amount = F.col("invoice_amount").cast("double")
    sold = F.col("sale_id").isNotNull()
    missing = sold & F.col("total_amount").isNull()
    is_paid, is_partial = F.col("status") == "Paid", F.col("status") == "Partial"

    total = F.when(missing, amount).otherwise(F.col("total_amount"))
    paid = F.when(missing, F.when(is_paid, amount).otherwise(0.0)).otherwise(F.col("sale_paid"))
    due = F.when(missing, F.when(is_paid, 0.0).otherwise(amount)).otherwise(F.col("sale_balance"))
    joined = joined.withColumns({"_total": total, "_paid": paid, "_due": due})

    nothing = F.coalesce("_paid", F.lit(0.0)) == 0
    settle = sold & is_paid & nothing
    derive = sold & is_partial & nothing & (F.coalesce("_total", F.lit(0.0)) != 0)
    sale_paid = (
        F.when(settle, amount)
        .when(derive, F.col("_total") - F.coalesce("_due", "_total"))
        .otherwise(F.col("_paid"))
    )
    sale_due = F.when(settle, 0.0).otherwise(F.col("_due"))
    return joined.select(
        F.col("id").alias("order_id"),
        "status",
        F.coalesce("_total", amount).alias("shown_total"),
        F.coalesce(F.col("amount_paid").cast("double"), sale_paid).alias("shown_paid"),
        F.coalesce(F.col("balance_due").cast("double"), sale_due).alias("shown_balance"),
    )


def create_orders(
    orders: DataFrame, items: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(new order rows, items linked to them).

    Requests: request_id (becomes the order id), customer_id, item_ids, invoice_amount,
    invoice_date, notes, requested_at. An item claimed twice goes to the later request.
    """
    fresh = assign_refs(
        requests, orders.select(F.col("order_ref").alias("ref")), "ORD-", 5, IN_TURN,
    )
    new = fresh.select(
        F.col("request_id").alias("id"), F.col("ref").alias("order_ref"), "customer_id",
        "item_ids", F.col("invoice_amount").cast(MONEY).alias("invoice_amount"),
        F.lit("Pending").alias("status"), "invoice_date",
        F.coalesce("notes", F.lit("")).alias("notes"), F.col("requested_at").alias("created_at"),
    )
    claims = requests.select(
        "requested_at", "request_id", F.explode("item_ids").alias("id")
    ).groupBy("id").agg(F.max(F.struct("requested_at", "request_id")).alias("_c"))
    link = claims.select("id", F.col("_c.request_id").alias("_order"))
    linked = items.join(link, "id", "left").withColumn(
        "order_id", F.coalesce("_order", "order_id")
    )
    return new, linked.select(items.columns)


def unknown_claims(items: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, item_id, reason) of items that order requests name but that do not exist."""
    claims = requests.select("request_id", F.explode("item_ids").alias("item_id")).distinct()
    return unknown_requests(claims, items, "item_id", "unknown item")


def regenerate_marks(
    customers: DataFrame, prefix: str, site: str, overrides: DataFrame | None = None
) -> DataFrame:
    """Customers with old and new mark and address; an override (id, mark) keeps the address."""
    df = customers.withColumn("_override", F.lit(None).cast("string"))
    if overrides is not None:
        side = overrides.select("id", F.col("mark").alias("_override"))
        df = customers.join(side, "id", "left")
    made = shipping_mark(F.col("name"), F.col("phone"), prefix)
    new_mark = F.coalesce("_override", made)
    address = F.when(F.col("_override").isNotNull(), F.col("shipping_address")).otherwise(
        shipping_address(made, site)
    )
    return df.select(
        "id", "name", F.col("shipping_mark").alias("old_mark"), new_mark.alias("new_mark"),
        F.col("shipping_address").alias("old_address"), address.alias("new_address"),
    )


def intake_customers(customers: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with reasons) of a batch of new customers.

    Rows are taken by id. A row is refused if a customer, or an accepted earlier row of the
    batch, has the same number in any spelling or the same e-mail; a refused row blocks nobody.
    The accepted set is a fixpoint: in each round the rows that are first for both of their keys
    are accepted, and rows that share a key with them leave. There are as many rounds as the
    longest chain of rows that decide one after the other, two rows a round.
    """
    keys = {"phone": phone_key(F.col("phone")), "email": F.lower(F.trim("email"))}
    rows = batch.select("id", *[blank_to_null(k).alias(f"_{n}") for n, k in keys.items()])
    known = {}
    for name, key in keys.items():
        known[name] = customers.select(blank_to_null(key).alias(f"_{name}")).filter(
            F.col(f"_{name}").isNotNull()).distinct()
    open_rows = rows
    for name in keys:
        open_rows = open_rows.join(known[name], f"_{name}", "left_anti")
    open_rows, accepted = durable(open_rows), None
    while not open_rows.isEmpty():
        leading = open_rows
        for name in keys:
            firsts = open_rows.filter(F.col(f"_{name}").isNotNull()).groupBy(f"_{name}").agg(
                F.min("id").alias(f"_first_{name}"))
            leading = leading.join(firsts, f"_{name}", "left").filter(
                F.col(f"_{name}").isNull() | (F.col("id") == F.col(f"_first_{name}")))
        leading = durable(leading.select("id", *[f"_{n}" for n in keys]))
        accepted = leading if accepted is None else accepted.unionByName(leading)
        open_rows = open_rows.join(leading.select("id"), "id", "left_anti")
        for name in keys:
            open_rows = open_rows.join(leading.select(f"_{name}"), f"_{name}", "left_anti")
        open_rows = durable(open_rows)
    accepted = rows.limit(0) if accepted is None else accepted
    verdict = rows
    for name in keys:
        taken = accepted.filter(F.col(f"_{name}").isNotNull()).select(f"_{name}", F.col("id").alias(f"_by_{name}"))
        owners = known[name].withColumn(f"_known_{name}", F.lit(True))
        verdict = verdict.join(taken, f"_{name}", "left").join(owners, f"_{name}", "left")

    def clash(name: str) -> Column:
        earlier = F.coalesce(F.col(f"_by_{name}") < F.col("id"), F.lit(False))
        return F.when(F.col(f"_known_{name}").isNotNull() | earlier, f"duplicate {name}")

    reasons = F.filter(F.array(*[clash(n) for n in keys]), lambda r: r.isNotNull())
    verdict = batch.join(verdict.select("id", reasons.alias("reasons")), "id")
    good = F.size("reasons") == 0
    return (
        verdict.filter(good).select(batch.columns),
        verdict.filter(~good).select(*batch.columns, "reasons"),
    )


def upsert_rates(rates: DataFrame, updates: DataFrame) -> DataFrame:
    return upsert_rows(rates, updates, "tier")


def save_settings(settings: DataFrame, new: DataFrame) -> DataFrame:
    """The single settings row after an update; it is created if there was none."""
    old = settings.limit(1).withColumn("_one", F.lit(1))
    given = new.limit(1).select(*[F.col(c).alias(f"_new_{c}") for c in new.columns])
    given = given.withColumn("_one", F.lit(1))
    merged = old.join(given, "_one", "full_outer")
    return merged.select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns else F.col(c)
            for c in settings.columns
        ]
    )


def patch_rows(target: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Patches: id, field, value (text, NULL clears), seq. The last value of a field wins;
    fields that are not given stay."""
    fields = [c for c in target.columns if c != key]
    place = F.struct("seq", "value")
    wide = patches.groupBy(key).agg(
        *[F.max(F.when(F.col("field") == c, place)).alias(f"_p_{c}") for c in fields]
    )
    joined = target.join(wide, key, "left")

    def patched(name):
        kind = target.schema[name].dataType
        given = F.col(f"_p_{name}")
        return (
            F.when(given.isNotNull(), given["value"].try_cast(kind))
            .otherwise(F.col(name))
            .alias(name)
        )

    return joined.select(*[F.col(c) if c == key else patched(c) for c in target.columns])


def unknown_patches(target: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Patches of rows or fields that do not exist, with the reason."""
    known = target.select(key, F.lit(True).alias("_known"))
    fields = [c for c in target.columns if c != key]
    reason = F.when(F.col("_known").isNull(), "unknown row").when(
        ~F.coalesce(F.col("field").isin(*fields), F.lit(False)), "unknown field")
    return patches.join(known, key, "left").withColumn("reason", reason).filter(
        "reason IS NOT NULL").drop("_known")


def close_registrations(registrations: DataFrame, customers: DataFrame) -> DataFrame:
    """Registrations whose e-mail or number now belongs to a customer become Created."""
    met = None
    for key in (F.lower(F.trim("email")), phone_key(F.col("phone"))):
        known = customers.select(blank_to_null(key).alias("_key"))
        hit = registrations.select("id", blank_to_null(key).alias("_key")).join(
            known, "_key", "left_semi"
        ).select("id")
        met = hit if met is None else met.unionByName(hit)
    flagged = _flag(registrations, met, "id")
    status = F.when(F.col("_flag").isNotNull(), "Created").otherwise(F.col("status"))
    return flagged.withColumn("status", status).select(registrations.columns)
