"""All queries of this package and their checks."""

from trovescan.llm import (  # noqa: F401
    alignment,
    chat,
    decontaminate,
    importance,
    jaccard,
    licenses,
    mixing,
    neighbours,
    packing,
    pii,
    quality,
    repeats,
    topk,
)
from trovescan.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
