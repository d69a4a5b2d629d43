"""Order-line enrichment: calendar, delivery flags, cost model, border lane.

All steps are narrow projections (no shuffle); Catalyst collapses them into
one Project inside whole-stage codegen and prunes unused inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiplens.config import (
    CANADA_REGION, CANCELLED_STATUSES, DEFAULT_COST, LANE_CROSS_BORDER, LANE_DOMESTIC,
    SHIPPING_CANCELED, CostParams,
)
from shiplens.functions.noise import key_digest, keyed_normal
from shiplens.functions.nullsafe import flag, null_max
from shiplens.operators.filters import shipped_status
from shiplens.operators.lookups import with_base_rate, with_zone_factor


def with_calendar(df: DataFrame) -> DataFrame:
    """+ ``order_month`` (``yyyy-MM`` text) and ``order_year``."""
    return df.withColumns({
        "order_month": F.date_format("order_ts", "yyyy-MM"),
        "order_year": F.year("order_ts"),
    })


def with_delivery_flags(df: DataFrame) -> DataFrame:
    """+ is_on_time, is_late, is_cancelled, is_in_full, is_otif,
    transit_variance_days, edd_met (0/1 ints; NULL comparisons count 0)."""
    real, sched = F.col("real_days"), F.col("sched_days")
    cancelled = flag(F.col("order_status").isin(*CANCELLED_STATUSES)
                     | (F.col("delivery_status") == SHIPPING_CANCELED))
    on_time = flag(real <= sched)
    variance = real - sched
    return df.withColumns({
        "is_on_time": on_time,
        "is_late": F.col("late_risk").try_cast("int"),
        "is_cancelled": cancelled,
        "is_in_full": F.lit(1) - cancelled,
        "is_otif": flag((on_time == 1) & (cancelled == 0)),
        "transit_variance_days": variance,
        "edd_met": flag(variance <= 0),
    })


def with_cost_model(df: DataFrame, params: CostParams = DEFAULT_COST,
                    rate_card=None, zone_card=None) -> DataFrame:
    """+ base_ship_rate, zone_factor, qty_surcharge, modeled_shipping_cost,
    reshipment_cost, cost_per_order, target_ship_cost, margin_leakage.

    Needs ``is_cancelled`` (delivery flags) and ``line_key`` (noise key).
    """
    df = with_base_rate(df, params.base_rate if rate_card is None else rate_card)
    df = with_zone_factor(df, params.zone_factor if zone_card is None else zone_card,
                          params.default_zone_factor)
    qty = F.col("qty")
    surcharge = F.when(qty.isNotNull(),
                       F.greatest(qty - 1, F.lit(0)) * F.lit(params.qty_surcharge))
    raw_cost = F.col("base_ship_rate") * F.col("zone_factor") + surcharge
    if params.noise_sigma:
        df = df.withColumn("__digest", key_digest(F.col(params.noise_key), params.noise_seed))
        raw_cost = raw_cost + keyed_normal(F.col("__digest"), params.noise_sigma)
    # The cost is NULL exactly where the rate or the quantity is.
    cost = F.when(F.col("base_ship_rate").isNotNull() & qty.isNotNull(),
                  F.greatest(raw_cost, F.lit(params.cost_floor)))
    target = F.col("sales") * F.lit(params.target_ratio)
    df = df.withColumns({"qty_surcharge": surcharge, "modeled_shipping_cost": cost}).drop("__digest")
    cost = F.col("modeled_shipping_cost")
    return df.withColumns({
        "reshipment_cost": F.when(F.col("is_cancelled") == 1, cost).otherwise(F.lit(0.0)),
        "cost_per_order": cost,
        "target_ship_cost": target,
        "margin_leakage": null_max(cost - target, 0.0),
    })


def with_border(df: DataFrame) -> DataFrame:
    """+ is_canada, lane, border_adj_real_days, border_adj_on_time.

    A modelled customs day is added to Canada-bound transit; OTIF itself is
    not adjusted.
    """
    is_canada = F.coalesce(F.col("order_region") == CANADA_REGION, F.lit(False))
    adj_days = F.col("real_days") + F.when(is_canada, 1).otherwise(0)
    return df.withColumns({
        "is_canada": is_canada,
        "lane": F.when(is_canada, LANE_CROSS_BORDER).otherwise(LANE_DOMESTIC),
        "border_adj_real_days": adj_days,
        "border_adj_on_time": flag(adj_days <= F.col("sched_days")),
    })


def enrich(order_lines: DataFrame, params: CostParams = DEFAULT_COST,
           statuses=None) -> DataFrame:
    """``order_lines`` -> ``order_enriched`` (shipped-status filter first, so
    the filter is pushed into the scan)."""
    kept = shipped_status(order_lines) if statuses is None else shipped_status(order_lines, statuses)
    out = with_calendar(kept)
    out = with_delivery_flags(out)
    out = with_cost_model(out, params)
    return with_border(out)
