"""Histories, timelines, log text and notifications."""

from pyspark.sql import DataFrame, functions as F

from cargoframe.functions.statuses import step_index
from cargoframe.functions.text import actor_email, blank_to_null, phone_chat
from cargoframe.operators.skew import HOT_ROWS, join_unique
from cargoframe.schema import ITEM_STATUSES, RECEIVED, SHIPPED
from cargoframe.sources.scratch import settle


def item_history(history: DataFrame, item_ids: DataFrame) -> DataFrame:
    ids = item_ids.select(F.col("id").alias("record_id"))
    return history.join(ids, "record_id", "left_semi").orderBy(
        "record_id", F.asc_nulls_last("changed_at"), "id"
    )


def item_timeline(items: DataFrame, history: DataFrame, containers: DataFrame) -> DataFrame:
    """Six steps per item with state, first time reached and the ETA on the shipped step.

    History is reduced to one row per item before the join, and the steps are unfolded last.
    """
    times = history.groupBy(F.col("record_id").alias("id")).agg(
        *[
            F.min(F.when(F.col("new_status") == s, F.col("changed_at"))).alias(f"_at{i}")
            for i, s in enumerate(ITEM_STATUSES)
        ]
    )
    etas = containers.select(F.col("id").alias("container_id"), F.col("eta").alias("_eta"))
    joined = (
        items.select("id", "status", "container_id", "date_received")
        .join(etas, "container_id", "left")
        .join(times, "id", "left")
        .withColumn("_now", step_index(F.col("status")))
    )
    steps = F.array(
        *[
            F.struct(
                F.lit(i).alias("step_no"), F.lit(s).alias("step"), F.col(f"_at{i}").alias("at")
            )
            for i, s in enumerate(ITEM_STATUSES)
        ]
    )
    unfolded = joined.select(
        "id", "_now", "date_received", "_eta", F.inline(steps)
    )
    no, now = F.col("step_no"), F.col("_now")
    received = F.when((F.col("step") == RECEIVED) & (no <= now), F.col("date_received"))
    return unfolded.select(
        F.col("id").alias("item_id"),
        no.alias("step_no"),
        "step",
        F.when(no < now, "completed").when(no == now, "current").otherwise("pending").alias("state"),
        F.coalesce("at", received).alias("reached_at"),
        F.when(F.col("step") == SHIPPED, F.col("_eta")).alias("eta"),
    )


def resolve_log_ids(
    logs: DataFrame, customers: DataFrame, items: DataFrame, id_pattern: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Replace record ids inside ``details`` by customer mark or name, else item ref.

    Logs without an id do not take part in any shuffle. Ids are looked up as text.
    """
    found = F.regexp_extract_all("details", F.lit(id_pattern), F.lit(0))
    tagged = logs.withColumn("_ids", found)
    plain = tagged.filter(F.size("_ids") == 0).drop("_ids")
    holders = tagged.filter(F.size("_ids") > 0)

    tokens = holders.select("id", F.explode(F.array_distinct("_ids")).alias("_token"))
    known = tokens.select("_token").distinct()
    names = customers.select(
        F.col("id").cast("string").alias("_token"),
        F.coalesce(blank_to_null(F.col("shipping_mark")), F.col("name")).alias("_customer"),
    )
    refs = items.select(
        F.col("id").cast("string").alias("_token"),
        blank_to_null(F.col("item_ref")).alias("_item"),
    )
    labels = known.join(names, "_token", "left").join(refs, "_token", "left").select(
        "_token", F.coalesce("_customer", "_item", "_token").alias("_label")
    )
    # an id that very many logs mention is looked up by broadcast
    labelled = join_unique(tokens, labels, ["_token"], "inner", hot_rows)
    # one map per log row: its size is the number of ids in that text
    maps = labelled.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("_token", "_label"))).alias("_labels")
    )
    between = F.split("details", id_pattern, -1)
    named = F.transform("_ids", lambda i: F.element_at(F.col("_labels"), i))
    rebuilt = F.array_join(
        F.transform(
            F.arrays_zip(between.alias("text"), F.col("_named").alias("name")),
            lambda p: F.concat(p["text"], F.coalesce(p["name"], F.lit(""))),
        ),
        "",
    )
    resolved = (
        holders.join(maps, "id")
        .withColumn("_named", named)
        .withColumn("details", rebuilt)
        .select(plain.columns)
    )
    return plain.unionByName(resolved)


def default_templates(spark) -> DataFrame:
    """Headline and body per item status."""
    rows = [
        (ITEM_STATUSES[0], "Parcel received", "We have received your parcel and will ship it soon."),
        (ITEM_STATUSES[1], "Parcel on its way", "Your parcel has left in a container."),
        (ITEM_STATUSES[2], "Parcel landed", "Your parcel has arrived and is being processed."),
        (ITEM_STATUSES[3], "Parcel in sorting", "Your parcel is being sorted for pickup."),
        (ITEM_STATUSES[4], "Parcel ready", "Your parcel is waiting to be collected."),
        (ITEM_STATUSES[5], "Parcel delivered", "Your parcel has been handed over."),
    ]
    return spark.createDataFrame(rows, "new_status string, headline string, body string")


#: Wording of what the templates lack; %s stand for name, order and status, or for the status.
CHAT = "Hi %s! Order %s has a new status: %s."
HEADLINE, BODY = "News about your parcel: %s", "The status of your parcel has changed to %s."


def notification_outbox(
    accepted_changes: DataFrame, customers: DataFrame, orders: DataFrame, templates: DataFrame,
    chat_text: str = CHAT, headline: str = HEADLINE, body: str = BODY,
) -> DataFrame:
    """One row per accepted status change of a customer who can be reached.

    Customers with an e-mail address get headline and body; those whose item is on an order
    get a chat text that names the order, with or without an address. Nothing is sent.
    """
    people = customers.select(
        F.col("id").alias("customer_id"), "name", blank_to_null(F.col("email")).alias("email"), "phone")
    known = orders.select(F.col("id").alias("order_id"), F.col("order_ref").alias("_order_ref"))
    status = F.col("new_status")
    # written once and narrow: the shuffles behind the changes go before those of the joins come
    changes = settle(accepted_changes.select("request_id", "id", "customer_id", "order_id", "new_status"), "changes", lean=True)
    # names and addresses come last, so no shuffle carries them; templates have one row per status
    joined = changes.join(known, "order_id", "left").join(people, "customer_id").join(
        F.broadcast(templates), "new_status", "left")
    mailed, ordered = F.col("email").isNotNull(), F.col("_order_ref").isNotNull()
    chat = F.format_string(chat_text, F.col("name"), F.col("_order_ref"), status)
    joined = joined.filter(mailed | ordered)
    return joined.select(
        "request_id", F.col("id").alias("item_id"), "customer_id", "email",
        F.split_part("name", F.lit(" "), F.lit(1)).alias("first_name"),
        F.when(mailed, F.coalesce("headline", F.format_string(headline, status))).alias("headline"),
        F.when(mailed, F.coalesce("body", F.format_string(body, status))).alias("body"),
        F.when(ordered, chat).alias("chat_text"),
        F.when(ordered, phone_chat(F.col("phone"))).alias("chat_phone"),
    )


def history_log(log: DataFrame, history: DataFrame) -> DataFrame:
    """The log with new transitions appended; columns the log lacks are dropped."""
    rows = history.withColumn("changed_by", actor_email(F.col("changed_by")))
    return log.unionByName(rows.select([c for c in log.columns if c in rows.columns]),
                           allowMissingColumns=True)


def activity_log(log: DataFrame, actions: DataFrame) -> DataFrame:
    """The log with new actions appended; entity fields default to empty text."""
    rows = actions
    for name in ("entity_type", "entity_id"):
        given = F.col(name).cast("string") if name in actions.columns else F.lit(None)
        rows = rows.withColumn(name, F.coalesce(given, F.lit("")))
    return log.unionByName(rows.select([c for c in log.columns if c in rows.columns]),
                           allowMissingColumns=True)
