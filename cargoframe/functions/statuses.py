"""Status steps, tiers and payment snapshots."""

from pyspark.sql import Column, functions as F, types as T

from cargoframe.schema import ITEM_STATUSES, LEGACY_TIERS


def mapped(value: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, replacement in mapping.items():
        chain = chain.when(value == key, F.lit(replacement))
    return chain if default is None else chain.otherwise(default)


def tier(raw: Column) -> Column:
    return mapped(raw, LEGACY_TIERS, default=raw)


def step_index(status: Column) -> Column:
    """0-based position in the item life cycle, -1 for an unknown status."""
    steps = F.array(*[F.lit(s) for s in ITEM_STATUSES])
    return F.coalesce(F.array_position(steps, status), F.lit(0)).cast("int") - F.lit(1)


# Alternative field names for the amounts of a payment snapshot.
_TOTAL = ("total_amount", "amount", "grand_total")
_PAID = ("amount_paid", "amount_received", "paid_amount", "paid")
_BALANCE = ("balance_due", "balance", "amount_due", "remaining")


def sale_amounts(payload: Column) -> tuple[Column, Column, Column]:
    """Total, paid and balance as doubles from a snapshot JSON (nested in ``data`` or not)."""
    amounts = [T.StructField(n, T.StringType()) for n in _TOTAL + _PAID + _BALANCE]
    outer = F.from_json(
        payload, T.StructType([T.StructField("data", T.StructType(amounts)), *amounts])
    )

    def first(fields):
        nested = F.coalesce(*[outer["data"][f] for f in fields])
        flat = F.coalesce(*[outer[f] for f in fields])
        picked = F.when(outer["data"].isNotNull(), nested).otherwise(flat)
        # a number at the start counts, whatever follows it
        number = F.regexp_extract(picked, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
        return number.try_cast("double")

    total = F.nullif(first(_TOTAL), F.lit(0.0))
    paid = F.coalesce(first(_PAID), F.lit(0.0))
    balance = F.coalesce(first(_BALANCE), total - paid, F.lit(0.0))
    return total, paid, balance
