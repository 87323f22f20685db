"""Rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """``F.round`` of a double, several times faster.

    ``F.round`` writes every number as decimal text. That decides only next to a half, or in numbers too large to
    tell; elsewhere the nearest whole number, divided by a power of ten, is the same double.
    """
    shifted = value * float(10**digits)
    whole = F.rint(shifted)
    clear = (F.abs(shifted) < 1e12) & (F.abs(shifted - whole) < 0.499)
    return F.when(clear, (whole + 0.0) / float(10**digits)).otherwise(F.round(value, digits))  # + 0.0: no -0.0
