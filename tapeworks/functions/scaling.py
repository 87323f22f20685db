"""Min-max scaling and its inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a constant column scales to 0."""
    span = F.nullif(high - low, F.lit(0.0))
    return F.when(value.isNotNull(), F.coalesce((value - low) / span, F.lit(0.0)))


def minmax_back(scaled: Column, low: Column, high: Column) -> Column:
    return scaled * (high - low) + low


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    broken = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~broken, value)
