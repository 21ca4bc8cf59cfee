"""The two read paths of the application: the revenue report and the item list."""

from pyspark.sql import DataFrame, functions as F

from cargoframe.operators import filters, links, listing, reports, windows


def revenue_report(
    orders: DataFrame, customers: DataFrame, items: DataFrame, as_of, date_from=None, date_to=None
) -> dict[str, DataFrame]:
    """All parts of the report. The day range applies to totals, top customers, analytics and
    outstanding payments, not to the monthly series and the number of shipments."""
    span = (date_from, date_to)
    totals = reports.revenue_totals(orders, *span).crossJoin(
        reports.revenue_current(orders, as_of, *span)
    ).crossJoin(reports.total_shipments(items))
    return {
        "totals": totals,
        "monthly_revenue": reports.monthly_revenue(orders, as_of),
        "monthly_shipments": reports.monthly_shipments(items, as_of),
        "top_customers": reports.top_customers(orders, customers, *span),
        "customer_analytics": reports.customer_analytics(orders, customers, *span).orderBy(
            F.desc("total_revenue"), "customer_id"
        ),
        "outstanding_payments": listing.outstanding_payments(orders, customers, *span),
    }


def item_list(
    items: DataFrame, customers: DataFrame, containers: DataFrame, needle: str | None = None,
    period: str = "all", as_of=None, page: int = 1, limit: int = 50, **equal,
) -> DataFrame:
    """Filter, search, one row per tracking number, period, page: a single lazy plan.

    The ETA is looked up for the rows of the page only.
    """
    found = filters.filter_items(items, **equal)
    found = filters.search_items(links.items_with_customer(found, customers), needle)
    latest = windows.dedupe_tracking(found)
    latest = filters.period_filter(latest, "date_received", period, as_of)
    rows = listing.paginate(latest, page, limit, listing.canonical_order("items"))
    return links.items_with_eta(rows, containers)
