"""Tagged unions and differences."""

from pyspark.sql import DataFrame, functions as F

from cargoframe.operators.filters import search_items
from cargoframe.schema import SORTING


def sorting_board(items_with_customer: DataFrame, needle: str | None = None) -> DataFrame:
    """Sorting list and missing list in one frame; an item may be on both."""
    found = search_items(items_with_customer, needle)
    sorting = found.filter(F.col("status") == SORTING).withColumn("board", F.lit("sorting"))
    missing = found.filter("is_missing").withColumn("board", F.lit("missing"))
    return sorting.unionByName(missing)


def load_rejections(requests: DataFrame, accepted: DataFrame) -> DataFrame:
    return requests.join(accepted.select("request_id"), "request_id", "left_anti")
