"""All registered queries and their checks."""

from trovescan.plans import (  # noqa: F401
    index_queries,
    judge_queries,
    search_queries,
    selection_queries,
    table_queries,
    text_queries,
)
from trovescan.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
