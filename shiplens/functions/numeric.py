"""Stable decimal places for aggregated doubles.

A distributed sum adds partial sums in an order that depends on the
partitioning, so its last bits are not reproducible run to run. Money and
day amounts are therefore reported to 4 decimals and ratios of such sums to
6 decimals. Rates that are ratios of integer counts are exact and are not
rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT_DP = 4
RATIO_DP = 6


def half_even(c: Column, scale: int = 0) -> Column:
    """Banker's rounding (Python's ``round`` semantics)."""
    return F.bround(c, scale)
