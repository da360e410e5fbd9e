"""Vector expressions on array columns, computed in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    An expression used inside a lambda is computed again for every element, and
    the optimizer may put a computed column back in there; the variable of a
    lambda is not touched.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    """Sum of an array, first element first."""
    return F.aggregate(values, F.lit(0.0), lambda so_far, x: so_far + x)


def l2_normalize(vector: Column) -> Column:
    """Scale to unit length; an all-zero vector stays as it is."""

    def scale(wide: Column) -> Column:
        norm = F.sqrt(total(F.transform(wide, lambda x: x * x)))
        return bind(
            norm, lambda n: F.when(n > 0, F.transform(wide, lambda x: x / n)).otherwise(wide)
        )

    return bind(vector.cast("array<double>"), scale)


def squared_distance(left: Column, right: Column) -> Column:
    """Squared Euclidean distance, summed from the first dimension to the last."""
    return total(
        F.zip_with(
            left.cast("array<double>"),
            right.cast("array<double>"),
            lambda x, y: (x - y) * (x - y),
        )
    )
