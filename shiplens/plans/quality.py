"""What would otherwise be lost silently: rejects and lines on default values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiplens.config import DEFAULT_COST, CostParams
from shiplens.operators.measures import LINES


def line_quality(df: DataFrame, params: CostParams = DEFAULT_COST, g=LINES) -> DataFrame:
    """One row, from the enriched lines or from their cube (month, region and mode
    are its keys): kept lines, lines without a month (absent from monthly tables),
    lines without a rate, and lines on the default zone factor."""
    on_card = F.coalesce(F.col("order_region").isin(*params.zone_factor), F.lit(False))
    has_rate = F.coalesce(F.col("shipping_mode").isin(*params.base_rate), F.lit(False))
    return df.agg(
        g.rows().alias("kept_lines"),
        g.rows(F.col("order_month").isNull()).alias("lines_without_month"),
        g.rows(~has_rate).alias("lines_without_rate"),
        g.rows(~on_card).alias("default_zone_lines"))


def check_rejects(rejects: dict, max_share: float) -> None:
    """Raise if malformed rows, or the values rejected in one column, exceed the share."""
    rows = max(1, rejects["raw_rows"])
    worst = max(v for k, v in rejects.items() if k != "raw_rows")
    if worst > max_share * rows:
        raise ValueError(f"{worst} of {rejects['raw_rows']} raw rows rejected: {rejects}")
