"""Named queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the test tables through the adapter, enriches the lines
(lazy; Catalyst fuses filter + projections into the scan stage) and runs
one plan. Each ``Query`` states which double columns are aggregated
money/day amounts (4 decimals) and which are ratios or carry the keyed noise
(6 decimals); the SQL oracle applies the same rounding. Doubles computed by
the same single IEEE operations everywhere (sales, targets, card values)
are left exact: rounding them would only create decimal ties.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiplens.config import DEFAULT_COST, CostParams
from shiplens.functions.numeric import AMOUNT_DP, RATIO_DP
from shiplens.operators import enrich as E
from shiplens.operators import filters as flt
from shiplens.operators.lookups import rate_card, with_base_rate, with_zone_factor, zone_card
from shiplens.plans import insights as R
from shiplens.plans import kpis as K
from shiplens.plans import marts as M
from shiplens.plans import roundtrips as RT
from shiplens.plans.quality import line_quality
from shiplens.sources.testdata import DIMENSIONS, order_lines_from_tables

NO_NOISE = CostParams(noise_sigma=0.0)


@dataclass(frozen=True)
class Query:
    """A named query: either ``fn(enriched_or_cube, grain)`` (an aggregate
    that also runs on the cube) or ``build(spark, sf_dir)`` (row level)."""

    build: Callable[[SparkSession, str], DataFrame] | None = None
    fn: Callable | None = None
    amounts: tuple = ()
    ratios: tuple = ()
    order: tuple = field(default=())  # column names; "-name" = descending


def lines(spark: SparkSession, sf_dir: str, dims=DIMENSIONS) -> DataFrame:
    return order_lines_from_tables(spark, sf_dir, dims)


def enriched(spark: SparkSession, sf_dir: str, params: CostParams = DEFAULT_COST, dims=DIMENSIONS) -> DataFrame:
    return E.enrich(lines(spark, sf_dir, dims), params)


def present(df: DataFrame, q: Query) -> DataFrame:
    """Apply the stable decimal places of ``q`` (and its order, if any).

    Ordered results are aggregates bounded by the key domains, so they are
    sorted in one partition, without the sampling job of a range exchange."""
    repl = {c: F.round(F.col(f"`{c}`"), AMOUNT_DP) for c in q.amounts}
    repl.update({c: F.round(F.col(f"`{c}`"), RATIO_DP) for c in q.ratios})
    out = df.withColumns(repl) if repl else df
    if not q.order:
        return out
    keys = [F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in q.order]
    return out.repartition(1).sortWithinPartitions(*keys)


# -- row-level queries -----------------------------------------------------------

LINE_VIEW = ("order_id", "line_key", "order_date", "order_status", "delivery_status",
             "real_days", "sched_days", "late_risk", "shipping_mode", "order_region",
             "market", "customer_segment", "category_name", "qty", "sales")


def _line_view(df: DataFrame) -> DataFrame:
    return df.withColumn("order_date", F.date_format("order_ts", "yyyy-MM-dd")).select(*LINE_VIEW)


def q_filter_shipped_status(spark, sf_dir):
    return _line_view(flt.shipped_status(lines(spark, sf_dir)))


def q_filter_failed_orders(spark, sf_dir):
    return _line_view(flt.failed_orders(enriched(spark, sf_dir)))


def q_filter_market_usca(spark, sf_dir):
    return _line_view(flt.market(enriched(spark, sf_dir)))


def q_filter_segment_corporate(spark, sf_dir):
    return _line_view(flt.segment(enriched(spark, sf_dir)))


def q_parse_order_dates(spark, sf_dir):
    """Order / ship timestamps written in the raw export's text format and
    parsed back by the ingest parser (every kept line)."""
    from shiplens.config import RAW_DATE_FORMAT
    from shiplens.sources.raw import parse_raw_ts

    text = flt.shipped_status(lines(spark, sf_dir, ())).select(
        "line_key",
        F.date_format("order_ts", RAW_DATE_FORMAT).alias("order_text"),
        F.date_format("ship_ts", RAW_DATE_FORMAT).alias("ship_text"))
    return text.select(
        "line_key", "order_text", "ship_text",
        F.date_format(parse_raw_ts(F.col("order_text")), "yyyy-MM-dd HH:mm").alias("order_parsed"),
        F.date_format(parse_raw_ts(F.col("ship_text")), "yyyy-MM-dd HH:mm").alias("ship_parsed"))


def q_order_month_year(spark, sf_dir):
    df = E.with_calendar(flt.shipped_status(lines(spark, sf_dir, ())))
    return df.select("line_key", F.date_format("order_ts", "yyyy-MM-dd").alias("order_date"),
                     "order_month", "order_year")


def q_delivery_flags(spark, sf_dir):
    df = E.with_delivery_flags(flt.shipped_status(lines(spark, sf_dir, ())))
    return df.select("line_key", "order_status", "delivery_status", "real_days", "sched_days",
                     "is_on_time", "is_late", "is_cancelled", "is_in_full", "is_otif",
                     "transit_variance_days", "edd_met")


def q_lookup_base_rate(spark, sf_dir):
    """Rate card as a dimension table: left join on unique keys."""
    df = with_base_rate(flt.shipped_status(lines(spark, sf_dir, ())), rate_card(spark))
    return df.select("line_key", "shipping_mode", "base_ship_rate")


def q_lookup_zone_factor(spark, sf_dir):
    """Zone card as a dimension table: left join on unique keys + default."""
    df = with_zone_factor(flt.shipped_status(lines(spark, sf_dir, ("customer",))), zone_card(spark))
    return df.select("line_key", "order_region", "zone_factor")


COST_COLS = ("line_key", "shipping_mode", "order_region", "qty", "is_cancelled", "base_ship_rate",
             "zone_factor", "qty_surcharge", "modeled_shipping_cost", "reshipment_cost",
             "cost_per_order")


def q_cost_model(spark, sf_dir):
    """Deterministic part of the cost model (noise sigma 0)."""
    return enriched(spark, sf_dir, NO_NOISE, ("customer",)).select(*COST_COLS)


def q_cost_model_noise(spark, sf_dir):
    """Cost model with the keyed invoice-variance noise (sigma 0.6, seed 42)."""
    return enriched(spark, sf_dir, dims=("customer",)).select(*COST_COLS)


def q_margin_leakage(spark, sf_dir):
    return enriched(spark, sf_dir, dims=("customer",)).select("line_key", "sales", "cost_per_order",
                                          "target_ship_cost", "margin_leakage")


def q_cross_border_lines(spark, sf_dir):
    return flt.market(enriched(spark, sf_dir, dims=("customer",))).select(
        "line_key", "order_region", "real_days", "sched_days", "is_canada", "lane",
        "border_adj_real_days", "border_adj_on_time")


def q_line_quality(spark, sf_dir):
    """Kept lines, and those without month, without rate, or on the default zone."""
    return line_quality(enriched(spark, sf_dir, dims=("customer",)))


# -- the query table ---------------------------------------------------------------

COST_ROW = ("base_ship_rate", "zone_factor", "qty_surcharge", "modeled_shipping_cost",
            "reshipment_cost", "cost_per_order")
RATES = ("otif_rate", "on_time_rate", "cancel_rate")

QUERIES: dict[str, Query] = {
    # filters
    "filter_shipped_status": Query(q_filter_shipped_status),
    "filter_failed_orders": Query(q_filter_failed_orders),
    "filter_market_usca": Query(q_filter_market_usca),
    "filter_segment_corporate": Query(q_filter_segment_corporate),
    "surge_months": Query(fn=M.surge_months,
                          ratios=("mean_orders", "std_orders", "surge_threshold")),
    # lookups and row expressions
    "lookup_base_rate": Query(q_lookup_base_rate, ratios=("base_ship_rate",)),
    "lookup_zone_factor": Query(q_lookup_zone_factor, ratios=("zone_factor",)),
    "parse_order_dates": Query(q_parse_order_dates),
    "order_month_year": Query(q_order_month_year),
    "delivery_flags": Query(q_delivery_flags),
    "cost_model": Query(q_cost_model, ratios=COST_ROW),
    "cost_model_noise": Query(q_cost_model_noise, ratios=COST_ROW),
    "margin_leakage": Query(q_margin_leakage,
                            ratios=("cost_per_order", "margin_leakage")),
    "cross_border_lines": Query(q_cross_border_lines),
    # KPI tables
    "kpi_otif_by_carrier": Query(fn=K.otif_by_carrier,
                                 ratios=RATES + ("avg_transit_variance", "avg_cost_per_order"),
                                 order=("-orders", "shipping_mode")),
    "kpi_otif_by_region": Query(fn=K.otif_by_region,
                                ratios=RATES + ("avg_cost_per_order",),
                                order=("-orders", "order_region")),
    "kpi_otif_monthly": Query(fn=K.otif_monthly, ratios=("otif_rate", "on_time_rate"),
                              order=("order_month",)),
    "kpi_cpo_region_carrier": Query(fn=K.cpo_region_carrier,
                                    amounts=("total_cost", "total_margin_leakage"),
                                    ratios=("avg_cost_per_order", "avg_margin_leakage"),
                                    order=("-total_cost", "order_region",
                                           "shipping_mode")),
    "kpi_cost_monthly": Query(fn=K.cost_monthly,
                              amounts=("total_shipping_cost", "total_margin_leakage"),
                              ratios=("avg_cost_per_order",), order=("order_month",)),
    "kpi_edd_by_carrier": Query(fn=K.edd_by_carrier,
                                ratios=("edd_met_rate", "avg_scheduled_days", "avg_real_days",
                                        "avg_variance"),
                                order=("shipping_mode",)),
    "kpi_failed_delivery_region": Query(fn=K.failed_delivery_region,
                                        amounts=("reshipment_cost",), ratios=("cum_pct",),
                                        order=("-failed_orders", "order_region")),
    "kpi_failed_delivery_category": Query(fn=K.failed_delivery_category,
                                          amounts=("reshipment_cost",), ratios=("cum_pct",),
                                          order=("-failed_orders", "category_name")),
    "kpi_failed_delivery_carrier": Query(fn=K.failed_delivery_carrier,
                                         amounts=("reshipment_cost",),
                                         order=("-failed_orders", "shipping_mode")),
    "kpi_cross_border_summary": Query(fn=K.cross_border_summary,
                                      ratios=("otif_rate", "on_time_rate_pre_customs_adj",
                                              "on_time_rate_post_customs_adj", "cancel_rate",
                                              "avg_cost_per_order", "avg_sales"),
                                      order=("lane",)),
    "kpi_cross_border_monthly": Query(fn=K.cross_border_monthly,
                                      order=("order_month", "lane")),
    "kpi_corporate_monthly": Query(fn=K.corporate_monthly, amounts=("total_sales",),
                                   ratios=("otif_rate", "avg_cost_per_order"),
                                   order=("order_month",)),
    "kpi_corporate_category": Query(fn=K.corporate_category, amounts=("total_sales",),
                                    ratios=("otif_rate",),
                                    order=("-orders", "category_name")),
    "kpi_monthly_by_segment": Query(fn=K.monthly_by_segment,
                                    order=("order_month", "customer_segment")),
    "scenario_rows": Query(fn=K.scenario_rows,
                           amounts=("total_cost", "total_margin_leakage",
                                    "savings_carrier_diversification", "savings_zone_skipping",
                                    "simulated_annual_savings"),
                           ratios=("avg_cost_per_order", "avg_margin_leakage"),
                           order=("-total_cost", "order_region", "shipping_mode")),
    "kpi_savings_simulation": Query(fn=K.savings_simulation,
                                    amounts=("current_total_cost", "savings_carrier_diversification",
                                             "savings_zone_skipping", "simulated_savings"),
                                    ratios=("savings_pct",),
                                    order=("-simulated_savings", "order_region")),
    "kpi_savings_by_lever": Query(fn=K.savings_by_lever, amounts=("annual_savings",),
                                  ratios=("pct_of_total_cost",)),
    "kpi_topline_summary": Query(fn=K.topline_summary),
    # chart / dashboard datasets
    "chart_otif_by_carrier": Query(fn=M.chart_otif_by_carrier,
                                   ratios=("otif_pct", "network_avg_pct", "axis_max_pct"),
                                   order=("-orders", "shipping_mode")),
    "chart_otif_monthly": Query(fn=M.chart_otif_monthly, ratios=("otif_pct", "on_time_pct"),
                                order=("order_month",)),
    "chart_cost_by_region": Query(fn=M.chart_cost_by_region,
                                  amounts=("total_cost", "total_cost_k"), ratios=("avg_cpo",)),
    "chart_leakage_by_region": Query(fn=M.chart_leakage_by_region,
                                     amounts=("total_margin_leakage", "total_margin_leakage_k")),
    "chart_edd_by_carrier": Query(fn=M.chart_edd_by_carrier,
                                  ratios=("edd_met_pct", "avg_variance")),
    "chart_pareto_region": Query(fn=M.chart_pareto_region, ratios=("cum_pct_100",)),
    "chart_pareto_category": Query(fn=M.chart_pareto_category, ratios=("cum_pct_100",)),
    "pareto_vital_few": Query(fn=M.pareto_vital_few, amounts=("reshipment_cost",),
                              ratios=("cum_pct",)),
    "chart_cross_border": Query(fn=M.chart_cross_border, ratios=("value_pct",)),
    "chart_corporate_surge": Query(fn=M.corporate_surge,
                                   ratios=("mean_orders", "std_orders", "surge_threshold"),
                                   order=("order_month",)),
    "chart_corporate_mix": Query(fn=M.chart_corporate_mix),
    "chart_savings_by_lever": Query(fn=M.chart_savings_by_lever,
                                    amounts=("annual_savings", "annual_savings_k"),
                                    ratios=("pct_of_total_cost",)),
    "dashboard_cards": Query(fn=M.dashboard_cards, order=("card",)),
    # workbook datasets
    "wb_topline": Query(fn=M.wb_topline, order=("row_no",)),  # rounds its rows itself
    "wb_otif_by_carrier": Query(fn=M.wb_otif_by_carrier,
                                ratios=RATES + ("avg_transit_variance", "avg_cost_per_order"),
                                order=("is_total", "-orders", "shipping_mode")),
    "wb_edd_by_carrier": Query(fn=M.wb_edd_by_carrier,
                               ratios=("avg_scheduled_days", "avg_real_days", "avg_variance",
                                       "edd_met_rate"),
                               order=("shipping_mode",)),
    "wb_pareto": Query(fn=M.wb_pareto, amounts=("reshipment_cost",), ratios=("cum_pct",),
                       order=("dimension", "-failed_orders", "key")),
    "wb_savings_by_lever": Query(fn=M.wb_savings_by_lever, amounts=("annual_savings",),
                                 ratios=("pct_of_total_cost",)),
    # report findings
    "tier_cost_ratio": Query(fn=R.tier_cost_ratio,
                             ratios=("avg_cost_per_order", "cost_ratio_vs_baseline")),
    "otif_monthly_range": Query(fn=R.otif_monthly_range,
                                ratios=("min_monthly_otif", "max_monthly_otif")),
    "pareto_top3_share": Query(fn=R.pareto_top3_share, ratios=("top_share",)),
    "failure_vs_volume": Query(fn=R.failure_vs_volume,
                               ratios=("failed_share", "volume_share", "failure_to_volume")),
    "customs_on_time_gap": Query(fn=R.customs_on_time_gap,
                                 ratios=("on_time_rate_pre_customs_adj", "on_time_rate_post_customs_adj",
                                         "on_time_drop")),
    "routing_guide": Query(fn=R.routing_guide,
                           ratios=("otif_rate", "edd_met_rate", "avg_variance", "avg_cost_per_order")),
    "failure_impact": Query(fn=R.failure_impact, amounts=("reshipment_cost",),
                            ratios=("failure_rate", "cost_per_failure")),
    "leakage_vs_cost_share": Query(fn=R.leakage_vs_cost_share,
                                   amounts=("total_cost", "total_margin_leakage"),
                                   ratios=("cost_share", "leakage_share")),
    "leakage_cost_corr": Query(fn=R.leakage_cost_corr, ratios=("cost_leakage_corr",)),
    "otif_by_year_carrier": Query(fn=R.otif_by_year_carrier, ratios=("otif_rate",)),
    # sources, sinks and quality
    "csv_roundtrip_otif": Query(RT.csv_roundtrip_otif, ratios=RATES + ("avg_transit_variance", "avg_cost_per_order")),
    "csv_ingest_rejects": Query(RT.csv_ingest_rejects),
    "line_quality": Query(q_line_quality),
    "csv_rejected_rows": Query(RT.csv_rejected_rows),
    "csv_line_breaks": Query(RT.csv_line_breaks),
    "csv_inferred_dates": Query(RT.csv_inferred_dates),
    "sink_late_month": Query(RT.sink_late_month, ratios=("otif_rate", "on_time_rate")),
    "sink_enriched_monthly": Query(RT.sink_enriched_monthly, ratios=("otif_rate", "on_time_rate")),
    "stored_kpi_summary": Query(RT.stored_kpi_summary),
    "stored_kpi_chart": Query(RT.stored_kpi_chart, amounts=("total_cost", "total_cost_k"), ratios=("avg_cpo",)),
    "stored_kpi_cards": Query(RT.stored_kpi_cards, order=("card",)),
    "stored_kpi_sheet": Query(RT.stored_kpi_sheet, ratios=("OTIF Rate", "Avg Cost/Order ($)")),
}


# Dimensions an aggregate query looks up; the others need customer alone.
NO_DIMENSION = frozenset((
    "kpi_otif_monthly", "kpi_edd_by_carrier", "chart_otif_by_carrier", "chart_otif_monthly",
    "chart_edd_by_carrier", "wb_edd_by_carrier", "otif_monthly_range", "otif_by_year_carrier",
))
PART_ONLY = frozenset(("chart_pareto_category", "failure_vs_volume"))
BOTH = frozenset(("kpi_failed_delivery_category", "kpi_corporate_category", "chart_corporate_mix", "wb_pareto"))


def dimensions(name: str) -> tuple:
    if name in NO_DIMENSION:
        return ()
    return ("part",) if name in PART_ONLY else DIMENSIONS if name in BOTH else ("customer",)


def build(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unrounded result of query ``name`` over the tables in ``sf_dir``."""
    q = QUERIES[name]
    if q.fn is None:
        return q.build(spark, sf_dir)
    return q.fn(enriched(spark, sf_dir, dims=dimensions(name)))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(build(name, spark, sf_dir), QUERIES[name])


def aggregate_queries() -> list[str]:
    """Queries that run on either grain (lines or cube)."""
    return [n for n, q in QUERIES.items() if q.fn is not None]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, _n=name: run(_n, spark, sf_dir)) for name in QUERIES}
