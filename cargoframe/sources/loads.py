"""Typed loads: raw table rows to canonical columns with business defaults.

A raw frame may lack optional columns; they become typed NULLs or the default.
Ids keep the type of the source.
"""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cargoframe import schema as S
from cargoframe.functions.statuses import tier
from cargoframe.functions.text import blank_to_null
from cargoframe.functions.times import time_column


def _field(df: DataFrame, name: str, kind="string") -> Column:
    if name not in df.columns:
        return F.lit(None).cast(kind)
    return F.col(name).cast(kind)


def _time(df, name):
    if name not in df.columns:
        return F.lit(None).cast("timestamp_ntz")
    return time_column(df, name)


def _key(df, *names):
    """First present column, unchanged in type; a link array gives its first element."""
    for name in names:
        if name in df.columns:
            if isinstance(df.schema[name].dataType, T.ArrayType):
                return F.get(F.col(name), F.lit(0))
            if isinstance(df.schema[name].dataType, T.StringType):
                return blank_to_null(F.col(name))
            return F.col(name)
    return F.lit(None).cast("string")


def _or(column: Column, default) -> Column:
    return F.coalesce(column, F.lit(default))


def _texts(df, *names):
    return [_or(_field(df, n), "").alias(n) for n in names]


def _optional(df, *names, kind="string"):
    return [_field(df, n, kind).alias(n) for n in names]


def load_customers(df: DataFrame) -> DataFrame:
    package = "package_raw" if "package_raw" in df.columns else "package"
    return df.select(
        "id",
        *_texts(df, "name", "phone", "email", "shipping_address", "shipping_mark"),
        _field(df, "login_uid").alias("login_uid"),
        _or(_field(df, "status"), "active").alias("status"),
        _field(df, "shipping_type").alias("shipping_type"),
        tier(_field(df, package)).alias("package"),
        _field(df, "exchange_rate", "double").alias("exchange_rate"),
        _field(df, "notes").alias("notes"),
        _key(df, "preferred_warehouse_id").alias("preferred_warehouse_id"),
        _time(df, "created_at").alias("created_at"),
    )


def load_items(df: DataFrame) -> DataFrame:
    """First status, centimetres and not-missing by default; a zero weight is no weight."""
    photos = F.array().cast(T.ArrayType(S.PHOTO))
    if "photos" in df.columns:
        photos = F.coalesce(F.col("photos"), photos)
    return df.select(
        "id",
        F.coalesce(_field(df, "item_ref"), F.col("id").cast("string")).alias("item_ref"),
        _key(df, "customer_id", "customer").alias("customer_id"),
        _key(df, "customer_name").alias("customer_name"),
        _key(df, "customer_shipping_mark").alias("customer_shipping_mark"),
        _key(df, "order_id", "order").alias("order_id"),
        _key(df, "container_id", "container").alias("container_id"),
        _field(df, "container_name").alias("container_name"),
        _or(_field(df, "status"), S.RECEIVED).alias("status"),
        _or(_field(df, "is_missing", "boolean"), False).alias("is_missing"),
        blank_to_null(_field(df, "shipping_type")).alias("shipping_type"),
        *_optional(df, "length", "width", "height", kind="double"),
        _or(_field(df, "dimension_unit"), "cm").alias("dimension_unit"),
        F.nullif(_field(df, "weight", "double"), F.lit(0.0)).alias("weight"),
        _field(df, "quantity", "int").alias("quantity"),
        _or(_field(df, "description"), "").alias("description"),
        blank_to_null(_field(df, "tracking_number")).alias("tracking_number"),
        _time(df, "date_received").alias("date_received"),
        *_optional(df, "est_price", "est_shipping_price", "pkg_est_shipping", kind=S.MONEY),
        *_optional(df, "pkg_shipping_rate", "special_shipping_rate", kind="double"),
        _field(df, "is_special_item", "boolean").alias("is_special_item"),
        *_optional(df, "special_rate_name", "notes", "created_by"),
        _time(df, "created_at").alias("created_at"),
        photos.alias("photos"),
    )


def load_orders(df: DataFrame) -> DataFrame:
    item_ids = F.array().cast("array<string>")
    if "item_ids" in df.columns:
        item_ids = F.coalesce(F.col("item_ids"), item_ids)
    return df.select(
        "id",
        F.coalesce(_field(df, "order_ref"), F.col("id").cast("string")).alias("order_ref"),
        _key(df, "customer_id", "customer").alias("customer_id"),
        _field(df, "customer_name").alias("customer_name"),
        item_ids.alias("item_ids"),
        F.coalesce(_field(df, "invoice_amount", S.MONEY), F.lit(0).cast(S.MONEY)).alias(
            "invoice_amount"
        ),
        _field(df, "discount", S.MONEY).alias("discount"),
        _or(_field(df, "status"), "Pending").alias("status"),
        _time(df, "invoice_date").alias("invoice_date"),
        _time(df, "created_at").alias("created_at"),
        *_optional(df, "notes", "sale_id", "sale_link"),
        *_optional(df, "amount_paid", "balance_due", kind=S.MONEY),
    )


def load_containers(df: DataFrame) -> DataFrame:
    """`eta` may arrive under its stored name `departure_date`."""
    eta = "eta" if "eta" in df.columns else "departure_date"
    item_ids = F.array().cast("array<string>")
    if "item_ids" in df.columns:
        item_ids = F.coalesce(F.col("item_ids"), item_ids)
    return df.select(
        "id",
        F.coalesce(_field(df, "container_ref"), F.col("id").cast("string")).alias("container_ref"),
        *_optional(df, "name", "description"),
        _or(_field(df, "status"), "Loading").alias("status"),
        item_ids.alias("item_ids"),
        F.size(item_ids).alias("item_count"),
        _time(df, eta).alias("eta"),
        _time(df, "arrival_date").alias("arrival_date"),
        _or(_field(df, "tracking_number"), "").alias("tracking_number"),
        *_optional(df, "notes", "created_by"),
        _time(df, "created_at").alias("created_at"),
    )


def load_status_history(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        _or(_field(df, "record_type"), "Item").alias("record_type"),
        _key(df, "record_id").alias("record_id"),
        *_texts(df, "record_ref", "previous_status", "new_status", "changed_by"),
        _or(_field(df, "changed_by_role"), "warehouse_staff").alias("changed_by_role"),
        _time(df, "changed_at").alias("changed_at"),
        _field(df, "notes").alias("notes"),
    )


def load_activity_logs(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        *_texts(df, "action", "user_email"),
        _or(_field(df, "user_role"), "warehouse_staff").alias("user_role"),
        *_texts(df, "details"),
        *_optional(df, "entity_type", "entity_id"),
        _time(df, "timestamp").alias("timestamp"),
        _field(df, "ip_address").alias("ip_address"),
    )


def load_users(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        *_texts(df, "login_uid", "email"),
        _or(_field(df, "role"), "customer").alias("role"),
        _key(df, "customer_id", "customer_record").alias("customer_id"),
        _key(df, "customer_name").alias("customer_name"),
        _time(df, "created_at").alias("created_at"),
        _time(df, "last_login").alias("last_login"),
    )


def load_suppliers(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        F.coalesce(_field(df, "supplier_ref"), F.col("id").cast("string")).alias("supplier_ref"),
        *_texts(df, "name"),
        *_optional(df, "category", "platform", "platform_link", "contact", "contact_method"),
        _field(df, "rating", "int").alias("rating"),
        *_optional(df, "notes", "created_by"),
        _time(df, "created_at").alias("created_at"),
    )


def load_warehouses(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        *_texts(df, "name", "address"),
        *_optional(df, "country", "phone"),
        _or(_field(df, "is_active", "boolean"), True).alias("is_active"),
        _time(df, "created_at").alias("created_at"),
    )


def load_registrations(df: DataFrame) -> DataFrame:
    """Anything but Created is Pending."""
    status = F.when(_field(df, "status") == "Created", "Created").otherwise("Pending")
    return df.select(
        "id",
        *_texts(df, "name", "phone"),
        blank_to_null(_field(df, "phone2")).alias("phone2"),
        *_texts(df, "email", "existing_mark", "location"),
        status.alias("status"),
        _time(df, "submitted_at").alias("submitted_at"),
        blank_to_null(_field(df, "notes")).alias("notes"),
    )


def load_special_rates(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        *_texts(df, "name"),
        *[_or(_field(df, n, "double"), 0.0).alias(n) for n in ("sea", "air")],
    )


def load_package_rates(df: DataFrame) -> DataFrame:
    return df.select(
        *_texts(df, "tier"),
        *[_or(_field(df, n, "double"), 0.0).alias(n) for n in ("sea", "air")],
    )


def load_settings(df: DataFrame) -> DataFrame:
    """The settings row; an empty table gives one row of NULLs."""
    first = df.select(
        _or(_field(df, "usd_to_local", "double"), 1.0).alias("usd_to_local"),
        _or(_field(df, "rate_per_cbm", "double"), 0.0).alias("rate_per_cbm"),
    ).limit(1)
    return df.sparkSession.range(1).join(F.broadcast(first), F.lit(True), "left").drop("id")


def load_rates(special: DataFrame, settings: DataFrame) -> DataFrame:
    """Special rates, each beside the exchange rate and the volume rate in force."""
    return load_special_rates(special).crossJoin(F.broadcast(load_settings(settings)))


def support_messages(tickets: DataFrame) -> DataFrame:
    """One typed row per message of the JSON thread kept on each ticket."""
    thread = F.from_json("messages", T.ArrayType(S.MESSAGE))
    return tickets.select(F.col("id").alias("ticket_id"), F.explode(thread).alias("m")).select(
        "ticket_id",
        F.col("m.id").alias("message_id"),
        "m.sender",
        F.col("m.senderName").alias("sender_name"),
        "m.content",
        F.coalesce(F.col("m.type"), F.lit("text")).alias("type"),
        F.col("m.fileUrl").alias("file_url"),
        F.col("m.fileName").alias("file_name"),
        F.col("m.fileSize").alias("file_size"),
        F.col("m.mimeType").alias("mime_type"),
        F.try_to_timestamp("m.timestamp").cast("timestamp_ntz").alias("sent_at"),
    )


def support_threads(messages: DataFrame) -> DataFrame:
    """Messages per sender and the last activity of each ticket."""
    return messages.groupBy("ticket_id").agg(
        F.count_if(F.col("sender") == "customer").alias("customer_messages"),
        F.count_if(F.col("sender") == "admin").alias("admin_messages"),
        F.sum(F.length("content")).alias("characters"),
        F.max("sent_at").alias("last_activity"),
    )
