"""Search, phone, mark, label and reference columns."""

from functools import reduce

from pyspark.sql import Column, functions as F

from cargoframe.functions.measures import cbm_total
from cargoframe.schema import DEFAULT_DIAL_CODE

_LOCAL = DEFAULT_DIAL_CODE.lstrip("+")


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def contains_any(columns, needle: str) -> Column:
    """Case-insensitive literal substring test; NULL columns never match."""
    wanted = F.lit(needle.lower())
    tests = [
        F.coalesce(F.contains(F.lower(F.col(c).cast("string")), wanted), F.lit(False))
        for c in columns
    ]
    return reduce(lambda a, b: a | b, tests)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def phone_e164(phone: Column) -> Column:
    """International form used on invoices; NULL when there are too few digits."""
    d = digits(phone)
    n = F.length(d)
    return (
        F.when(d.startswith(_LOCAL) & (n >= 12), F.concat(F.lit("+"), d))
        .when(d.startswith("0") & (n == 10), F.concat(F.lit(DEFAULT_DIAL_CODE), F.substring(d, 2, 99)))
        .when(n >= 10, F.concat(F.lit("+"), d))
    )


def phone_chat(phone: Column) -> Column:
    """Form used for chat messages; short numbers stay as typed."""
    d = digits(phone)
    n = F.length(d)
    return (
        F.when(d.startswith("0") & (n == 10), F.concat(F.lit(DEFAULT_DIAL_CODE), F.substring(d, 2, 99)))
        .when(n > 10, F.concat(F.lit("+"), d))
        .otherwise(phone)
    )


def phone_key(phone: Column) -> Column:
    """One key for all spellings of a number; unusable numbers key on their own text."""
    return F.coalesce(phone_e164(phone), F.lower(F.trim(phone)))


def shipping_mark(name: Column, phone: Column, prefix: str) -> Column:
    """Prefix, initials of the first two words (X if a word has no letter), last four digits."""
    words = F.split(F.trim(name), r"\s+")

    def initial(position):
        letters = F.regexp_replace(F.get(words, F.lit(position)), r"[^A-Za-z]", "")
        return F.coalesce(blank_to_null(F.upper(F.substring(letters, 1, 1))), F.lit("X"))

    return F.concat(F.lit(prefix), initial(0), initial(1), F.right(digits(phone), F.lit(4)))


def shipping_address(mark: Column, site: str) -> Column:
    return F.concat(mark, F.lit(", " + site))


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")


def _fixed(value: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", value)


def line_label(limit: int | None = 200) -> Column:
    """Invoice line text: description or ref, then tracking number and volume."""
    head = F.coalesce(blank_to_null(F.col("description")), F.col("item_ref"))
    volume = cbm_total()
    return _label(head, volume, "m3]", limit)


def first_line_label() -> Column:
    """Line text of the invoice issued with a new order (not shortened)."""
    description = blank_to_null(F.col("description"))
    head = F.coalesce(
        F.concat(F.lit("Freight: "), description),
        F.concat(F.lit("Freight Item ("), F.col("item_ref"), F.lit(")")),
    )
    return _label(head, cbm_total(), " m3]", None)


def _label(head: Column, volume: Column, unit: str, limit: int | None) -> Column:
    tracking = blank_to_null(F.col("tracking_number"))
    text = F.concat(
        head,
        F.coalesce(F.concat(F.lit(" [TRK: "), tracking, F.lit("]")), F.lit("")),
        F.when(volume > 0, F.concat(F.lit(" [CBM: "), _fixed(volume, 4), F.lit(unit))).otherwise(""),
    )
    text = printable(text)
    return F.substring(text, 1, limit) if limit else text


def padded(number: Column, width: int) -> Column:
    """Zero-pad to a width without ever cutting longer numbers."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def reference(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), padded(number, width))


def actor_email(actor: Column) -> Column:
    return F.when(F.contains(actor, F.lit("@")), actor)
