"""Null semantics of the source analysis, stated as Spark columns.

The source ran on pandas, where a comparison with a missing value is
False (so a 0/1 flag becomes 0) and ``max(NaN, 0)`` stays missing. Spark's
three-valued logic gives NULL for the first and 0 for the second, so both
need a helper.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """0/1 integer flag; a NULL condition counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def null_max(x: Column, floor) -> Column:
    """``greatest(x, floor)`` that keeps NULL when ``x`` is NULL.

    Spark's ``greatest`` skips NULL arguments, pandas/numpy keep NaN.
    """
    return F.when(x.isNotNull(), F.greatest(x, F.lit(floor)))


def safe_div(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero or NULL divisor (ANSI-safe)."""
    return F.try_divide(num, den)
