"""Timestamps without zone, month keys and period bounds.

Everything is TIMESTAMP_NTZ, so results do not depend on the session time zone.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from cargoframe.functions.text import blank_to_null


def time_column(df: DataFrame, name: str) -> Column:
    """The column as TIMESTAMP_NTZ; blank or unparseable text becomes NULL."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_timestamp(blank_to_null(F.col(name))).cast("timestamp_ntz")
    return F.col(name).cast("timestamp_ntz")


def moment(value: str | dt.date | dt.datetime) -> Column:
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def day(value: str | dt.date | dt.datetime) -> Column:
    return moment(value).cast("date")


def month_start(value: Column) -> Column:
    return F.trunc(value.cast("date"), "month")


def month_key(value: Column) -> Column:
    return F.date_format(value.cast("date"), "yyyy-MM")


def due_date(issued: Column, days: int = 30) -> Column:
    return F.date_add(issued.cast("date"), days)


def between_days(column: Column, date_from=None, date_to=None) -> Column:
    """Inclusive day range, written half-open so that it can be pushed to the scan."""
    test = column.isNotNull()
    if date_from is not None:
        test = test & (column >= moment(date_from))
    if date_to is not None:
        test = test & (column < F.date_add(day(date_to), 1).cast("timestamp_ntz"))
    return test


def since(period: str, as_of) -> Column:
    """Start of today / the last 7 days / one month back / one year back (months clamp)."""
    now = moment(as_of)
    if period == "today":
        return day(as_of).cast("timestamp_ntz")
    steps = {"week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}
    return now - F.expr(steps[period])
