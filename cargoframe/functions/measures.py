"""Volume, money and rounding columns."""

from pyspark.sql import Column, functions as F

from cargoframe.schema import CUBIC_INCH_CM3, MONEY


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round halves towards +infinity on doubles, as ``floor(x * 10^n + 0.5) / 10^n``."""
    scale = 10**digits
    return F.floor(value.cast("double") * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def cents(value: Column) -> Column:
    return round_half_up(value, 2).cast(MONEY)


def _box_cm3(length, width, height, unit) -> Column:
    factor = F.when(F.col(unit) == "inches", F.lit(CUBIC_INCH_CM3)).otherwise(F.lit(1.0))
    return F.col(length) * F.col(width) * F.col(height) * factor


def cbm_unit(length="length", width="width", height="height", unit="dimension_unit") -> Column:
    """Cubic metres of one piece; a missing or zero side gives 0."""
    return F.coalesce(_box_cm3(length, width, height, unit) / F.lit(1e6), F.lit(0.0))


def cbm_total(
    length="length", width="width", height="height", unit="dimension_unit", quantity="quantity"
) -> Column:
    """Cubic metres of the whole line; a missing quantity counts as one piece."""
    pieces = F.coalesce(F.col(quantity), F.lit(1))
    return F.coalesce(
        _box_cm3(length, width, height, unit) * pieces / F.lit(1e6), F.lit(0.0)
    )


def cube_side(volume: Column) -> Column:
    """Side in cm of the cube with this volume in cubic metres; NULL when not positive."""
    return F.when(volume > 0, round_half_up(F.cbrt(volume * F.lit(1e6)), 6))


def pieces(quantity: Column) -> Column:
    """Quantity used in pricing: at least one."""
    return F.greatest(F.lit(1), F.coalesce(quantity, F.lit(1)))


def fx_rate(rate: Column) -> Column:
    return F.when(rate > 0, rate).otherwise(F.lit(1.0))


def to_local(amount: Column, rate: Column) -> Column:
    return round_half_up(amount.cast("double") * fx_rate(rate))


def discount_amount(base: Column, value: Column, mode: Column) -> Column:
    """Discount in the base currency from a percentage (``pct``) or a fixed value."""
    base, value = base.cast("double"), value.cast("double")
    percent = round_half_up(base * (value / F.lit(100.0)))
    picked = F.when(mode == "pct", percent).otherwise(value)
    given = (F.coalesce(value, F.lit(0.0)) != 0) & (F.coalesce(base, F.lit(0.0)) != 0)
    return F.when(given, picked).otherwise(F.lit(0.0))


def net_amount(base: Column, discount: Column) -> Column:
    return F.greatest(F.lit(0.0), base.cast("double") - discount.cast("double"))


def charge_basis() -> Column:
    """``volume``, ``weight`` or NULL: what a list shows and charges for an item."""
    boxed = cbm_unit() != 0
    by_volume = boxed & (
        (F.col("shipping_type") == "sea") | F.col("shipping_type").isNull()
    )
    has_weight = F.coalesce(F.col("weight"), F.lit(0.0)) != 0
    return F.when(by_volume, "volume").when(has_weight, "weight")
