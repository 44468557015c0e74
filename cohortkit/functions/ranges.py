"""Where a value stands among sorted bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_index(value: Column, bounds: Sequence[object]) -> Column:
    """How many of the ascending bounds are not above the value, by halving; 0 for null."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(bounds[middle]), between(low, middle)).otherwise(
            between(middle + 1, high)
        )

    return F.when(value.isNull(), F.lit(0)).otherwise(between(0, len(bounds)))
