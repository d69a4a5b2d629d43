"""Display text for KPI cards and chart labels (JVM-side formatting)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_text(c: Column) -> Column:
    """Integer with thousands separators: ``178,626``."""
    return F.format_number(c.cast("double"), 0)


def money_text(c: Column) -> Column:
    """Whole dollars with separators: ``$3,738,121``."""
    return F.concat(F.lit("$"), F.format_number(c, 0))


def pct_text(rate: Column, dp: int = 1) -> Column:
    """A 0..1 rate as percent text: ``40.9%``."""
    return F.concat(F.format_number(rate * 100, dp), F.lit("%"))


def thousands_text(c: Column) -> Column:
    """Dollars in thousands: ``$97k``."""
    return F.concat(F.lit("$"), F.format_number(c / 1000, 0), F.lit("k"))
