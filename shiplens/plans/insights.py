"""Findings the written report states as numbers, made reproducible.

Each is a small query over the KPI aggregates; windows run over aggregated
rows (tiers, months, regions, categories), never over lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiplens.config import BASELINE_TIER, LANE_CROSS_BORDER
from shiplens.functions.nullsafe import safe_div
from shiplens.operators.filters import non_null_keys
from shiplens.operators.measures import LINES, mean, orders, rate, total
from shiplens.operators.pareto import with_rank
from shiplens.plans import kpis

def _whole():
    return Window.partitionBy()

def tier_cost_ratio(df: DataFrame, g=LINES, baseline: str = BASELINE_TIER) -> DataFrame:
    """Each tier's average cost relative to the baseline tier."""
    k1 = kpis.otif_by_carrier(df, g).select("shipping_mode", "orders", "avg_cost_per_order")
    base = F.max(F.when(F.col("shipping_mode") == baseline, F.col("avg_cost_per_order"))).over(_whole())
    return k1.withColumn("cost_ratio_vs_baseline", safe_div(F.col("avg_cost_per_order"), base))

def otif_monthly_range(df: DataFrame, g=LINES) -> DataFrame:
    """R2: lowest and highest monthly OTIF rate."""
    k3 = kpis.otif_monthly(df, g)
    return k3.agg(F.count("*").alias("months"),
                  F.min("otif_rate").alias("min_monthly_otif"),
                  F.max("otif_rate").alias("max_monthly_otif"))

def pareto_top3_share(df: DataFrame, g=LINES, top: int = 3) -> DataFrame:
    """Share of failures in the top regions."""
    ranked = with_rank(kpis.failed_delivery_region(df, g), "order_region")
    return ranked.agg(
        F.sum(F.when(F.col("pareto_rank") <= top, F.col("failed_orders"))).cast("long").alias("top_failed_orders"),
        F.sum("failed_orders").cast("long").alias("total_failed_orders"),
        F.max(F.when(F.col("pareto_rank") <= top, F.col("cum_pct"))).alias("top_share"))

def failure_vs_volume(df: DataFrame, g=LINES) -> DataFrame:
    """Per category, share of failures vs share of volume."""
    failed = F.col("is_cancelled") == 1
    agg = non_null_keys(df, ["category_name"]).groupBy("category_name").agg(
        orders(g).alias("orders"), orders(g, failed).alias("failed_orders"))
    out = agg.withColumns({
        "failed_share": safe_div(F.col("failed_orders"), F.sum("failed_orders").over(_whole())),
        "volume_share": safe_div(F.col("orders"), F.sum("orders").over(_whole())),
    })
    return out.withColumn("failure_to_volume", safe_div(F.col("failed_share"), F.col("volume_share")))

def customs_on_time_gap(df: DataFrame, g=LINES) -> DataFrame:
    """On-time rate before / after the modelled customs day per lane."""
    k10 = kpis.cross_border_summary(df, g)
    return k10.select(
        "lane", "orders", "on_time_rate_pre_customs_adj", "on_time_rate_post_customs_adj",
        (F.col("on_time_rate_pre_customs_adj") - F.col("on_time_rate_post_customs_adj"))
        .alias("on_time_drop"),
        (F.col("lane") == LANE_CROSS_BORDER).alias("is_cross_border"))

def routing_guide(df: DataFrame, g=LINES) -> DataFrame:
    """Per tier, whether the promise holds and at what cost (K1 and K6
    share their key, so one aggregate serves both)."""
    t = non_null_keys(df, ["shipping_mode"]).groupBy("shipping_mode").agg(
        orders(g).alias("orders"),
        rate(g, "is_otif").alias("otif_rate"),
        rate(g, "edd_met").alias("edd_met_rate"),
        mean(g, "transit_variance_days").alias("avg_variance"),
        mean(g, "cost_per_order").alias("avg_cost_per_order"))
    by_cost = Window.orderBy(F.col("avg_cost_per_order").asc(), F.col("shipping_mode").asc())
    return t.withColumns({
        "meets_promise": F.coalesce(F.col("avg_variance") <= 0, F.lit(False)),
        "cost_rank": F.row_number().over(by_cost),
    })

def failure_impact(df: DataFrame, g=LINES) -> DataFrame:
    """Per region, failure rate next to its reshipment cost impact."""
    failed = F.col("is_cancelled") == 1
    agg = non_null_keys(df, ["order_region"]).groupBy("order_region").agg(
        orders(g).alias("orders"),
        orders(g, failed).alias("failed_orders"),
        rate(g, "is_cancelled").alias("failure_rate"),
        total(g, "reshipment_cost", failed).alias("reshipment_cost"))
    return agg.withColumn("cost_per_failure", safe_div(F.col("reshipment_cost"), F.col("failed_orders")))

def leakage_vs_cost_share(df: DataFrame, g=LINES) -> DataFrame:
    """Per region, share of total cost and share of total leakage."""
    r = kpis.cost_by_region(df, g)
    return r.select(
        "order_region", "total_cost", "total_margin_leakage",
        safe_div(F.col("total_cost"), F.sum("total_cost").over(_whole())).alias("cost_share"),
        safe_div(F.col("total_margin_leakage"), F.sum("total_margin_leakage").over(_whole()))
        .alias("leakage_share"))

def leakage_cost_corr(df: DataFrame, g=LINES) -> DataFrame:
    """R8 (second half): correlation of region cost and region leakage."""
    r = kpis.cost_by_region(df, g)
    return r.agg(F.count("*").alias("regions"),
                 F.corr("total_cost", "total_margin_leakage").alias("cost_leakage_corr"))

def otif_by_year_carrier(df: DataFrame, g=LINES) -> DataFrame:
    """OTIF per year and tier."""
    return non_null_keys(df, ["order_year", "shipping_mode"]).groupBy("order_year", "shipping_mode").agg(
        orders(g).alias("orders"), rate(g, "is_otif").alias("otif_rate"))

__all__ = [
    "tier_cost_ratio", "otif_monthly_range", "pareto_top3_share", "failure_vs_volume",
    "customs_on_time_gap", "routing_guide", "failure_impact", "leakage_vs_cost_share",
    "leakage_cost_corr", "otif_by_year_carrier",
]
