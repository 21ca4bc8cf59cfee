"""Registry of ready-to-run queries, each beside the SQL that states the same result.

The SQL texts use named views (``v_`` raw tables, ``t_`` loaded tables) and a few
abbreviations, which ``compose`` expands into one standalone statement.
"""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from cargoframe.functions.measures import round_half_up
from cargoframe.plans.views import VIEWS

AS_OF = "2001-08-01 00:00:00"
FROM, TO = "1998-01-01", "1998-12-31"
FX = 12.5

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_FACTOR = "CASE WHEN dimension_unit = 'inches' THEN 16.387064e0 ELSE 1e0 END"
_SHORT = {
    "{CBM}": f"coalesce(length * width * height * {_FACTOR} / 1e6, 0e0)",
    "{CBMQ}": f"coalesce(length * width * height * {_FACTOR} * coalesce(quantity, 1) / 1e6, 0e0)",
    "{AS_OF}": f"TIMESTAMP '{AS_OF}'",
    "{RANGE}": "coalesce(invoice_date, created_at) >= TIMESTAMP '1998-01-01' "
               "AND coalesce(invoice_date, created_at) < TIMESTAMP '1999-01-01'",
}


def _expand(text: str) -> str:
    for short, full in _SHORT.items():
        text = text.replace(short, full)
    # TS(x): time as text; R2(x) / R4(x): half-up rounding of a double
    text = re.sub(r"\bTS\(([^()]*)\)", r"strftime(\1, '%Y-%m-%d %H:%M:%S.%f')", text)
    for digits, scale in (("2", "1e2"), ("4", "1e4"), ("6", "1e6")):
        text = _wrap(text, f"R{digits}", f"(floor(({{}}) * {scale} + 0.5e0) / {scale})")
    return text


def _wrap(text: str, name: str, template: str) -> str:
    """Replace ``name(...)`` with balanced parentheses by the template."""
    while (match := re.search(rf"\b{name}\(", text)) is not None:
        depth, end = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = text[match.end():end - 1]
        text = text[:match.start()] + template.format(inner) + text[end:]
    return text


def compose(body: str) -> str:
    """Prefix the views the body needs, in dependency order."""
    needed: list[str] = []

    def visit(text):
        for name in re.findall(r"\b[vt]_[a-z_]+\b", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    body = body.strip()
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in needed]
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    recursive = "RECURSIVE " if head and head.group(1) else ""
    if not ctes:
        return _expand(body)
    if head:
        return _expand(f"WITH {recursive}" + ",\n".join(ctes) + ",\n" + body[head.end():])
    return _expand("WITH " + ",\n".join(ctes) + "\n" + body)


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame and its SQL."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = compose(sql)
        return build

    return register


def plain(df: DataFrame, *columns: str, text: tuple[str, ...] = (), round_to: int | None = 6):
    """Result in simple types: times as text, decimals as doubles, nullable ids as text."""
    chosen = list(columns) or df.columns
    out = []
    for name in chosen:
        kind = df.schema[name].dataType
        column = F.col(name)
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "; ")
        elif isinstance(kind, T.DoubleType) and round_to is not None:
            column = round_half_up(column, round_to)
        elif name in text:
            column = column.cast("string")
        out.append(column.alias(name))
    return df.select(*out)


#: Orders of which every seventh refers to a customer that does not exist.
STRAY_SQL = """(SELECT * REPLACE (
 CASE WHEN id % 7 = 0 THEN -customer_id ELSE customer_id END AS customer_id) FROM t_orders)"""


def stray_orders(orders):
    link = F.col("customer_id")
    return orders.withColumn("customer_id", F.when(F.col("id") % 7 == 0, -link).otherwise(link))
