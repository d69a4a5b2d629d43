"""Additive measures over two grains: order lines, or a pre-aggregated cube.

Every KPI is a group-by whose measures are counts, sums, minima and maxima
(means and rates are divided last, never averaged twice). A KPI written
against a ``Grain`` therefore runs unchanged on

- ``LINES``: the enriched order lines (one hash aggregate, partial
  aggregation before the shuffle), or
- ``CUBE``: a small cube of the lines keyed by month, region, mode, segment,
  category, market and cancellation (``build_cube``). The batch job scans
  the lines once to build the cube and derives all KPI tables from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiplens.functions.nullsafe import safe_div

CUBE_KEYS = (
    "order_month", "order_year", "order_region", "shipping_mode",
    "customer_segment", "category_name", "market", "is_cancelled",
)
# Columns whose non-NULL count the cube keeps (order counts and means).
CUBE_COUNTS = (
    "order_id", "transit_variance_days", "sched_days", "real_days", "cost_per_order",
    "margin_leakage", "sales",
)
# Columns whose sum the cube keeps (flags never hold NULL: their rates use
# the row count).
CUBE_SUMS = (
    "is_on_time", "is_otif", "is_cancelled", "edd_met", "border_adj_on_time",
    "transit_variance_days", "sched_days", "real_days", "cost_per_order",
    "margin_leakage", "reshipment_cost", "qty", "sales", "qty_surcharge",
)
CUBE_EXTREMES = ("order_ts",)


def _when(c: Column, where: Column | None) -> Column:
    return c if where is None else F.when(where, c)


class _Lines:
    """Aggregates over order lines."""

    name = "lines"

    def rows(self, where: Column | None = None) -> Column:
        return F.count(_when(F.lit(1), where))

    def n(self, col: str, where: Column | None = None) -> Column:
        return F.count(_when(F.col(col), where))

    def s(self, col: str, where: Column | None = None) -> Column:
        return F.sum(_when(F.col(col), where))

    def lo(self, col: str) -> Column:
        return F.min(col)

    def hi(self, col: str) -> Column:
        return F.max(col)


class _Cube:
    """Aggregates over the cube built by ``build_cube`` (sums of partials)."""

    name = "cube"

    def rows(self, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(_when(F.col("n__rows"), where)), F.lit(0)).cast("long")

    def n(self, col: str, where: Column | None = None) -> Column:
        if col not in CUBE_COUNTS:
            raise KeyError(f"the cube keeps no count of {col!r}; add it to CUBE_COUNTS")
        return F.coalesce(F.sum(_when(F.col(f"n__{col}"), where)), F.lit(0)).cast("long")

    def s(self, col: str, where: Column | None = None) -> Column:
        if col not in CUBE_SUMS:
            raise KeyError(f"the cube keeps no sum of {col!r}; add it to CUBE_SUMS")
        return F.sum(_when(F.col(f"s__{col}"), where))

    def lo(self, col: str) -> Column:
        return F.min(f"lo__{col}")

    def hi(self, col: str) -> Column:
        return F.max(f"hi__{col}")


LINES = _Lines()
CUBE = _Cube()


def build_cube(enriched: DataFrame) -> DataFrame:
    """Pre-aggregate enriched lines to the cube grain (size bounded by the key
    domains, not by the number of lines)."""
    aggs = [F.count(F.lit(1)).alias("n__rows")]
    aggs += [F.count(c).alias(f"n__{c}") for c in CUBE_COUNTS]
    aggs += [F.sum(c).alias(f"s__{c}") for c in CUBE_SUMS]
    for c in CUBE_EXTREMES:
        aggs += [F.min(c).alias(f"lo__{c}"), F.max(c).alias(f"hi__{c}")]
    return enriched.groupBy(*CUBE_KEYS).agg(*aggs)


# -- measure vocabulary -------------------------------------------------------

def orders(g, where: Column | None = None) -> Column:
    """Order-line count: non-NULL order ids (not distinct orders)."""
    return g.n("order_id", where)


def rate(g, flag_col: str, where: Column | None = None) -> Column:
    """Mean of a 0/1 flag over all rows (flags are never NULL)."""
    return safe_div(g.s(flag_col, where), g.rows(where))


def mean(g, col: str, where: Column | None = None) -> Column:
    """Mean over non-NULL values; NULL for an all-NULL group."""
    return safe_div(g.s(col, where), g.n(col, where))


def total(g, col: str, where: Column | None = None) -> Column:
    """Sum over non-NULL values; 0 for an all-NULL group (pandas ``sum``)."""
    return F.coalesce(g.s(col, where).cast("double"), F.lit(0.0))


def count_sum(g, col: str, where: Column | None = None) -> Column:
    """Sum of an integer column (0 for an all-NULL group)."""
    return F.coalesce(g.s(col, where), F.lit(0)).cast("long")
