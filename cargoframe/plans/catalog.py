"""All registered queries and their SQL."""

from cargoframe.plans import queries_jobs, queries_lists, queries_reports  # noqa: F401
from cargoframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
