"""KPI tables K1-K19 and the savings scenario (H1-H6).

Each builder takes the enriched lines (grain ``LINES``) or the cube (grain
``CUBE``) and returns an unrounded, unsorted DataFrame; ``present`` in the
registry applies the stable decimal places and the presentation order.
Every builder is one hash aggregate (partial aggregation before a shuffle
of at most #keys rows per task), optionally followed by a window over the
aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiplens.config import (
    CANADA_REGION, CORPORATE_SEGMENT, DEFAULT_SCENARIO, LANE_CROSS_BORDER, LANE_DOMESTIC,
    LEVER_A_LABEL, LEVER_B_LABEL, LEVER_C_LABEL, USCA_MARKET, ScenarioParams,
)
from shiplens.functions.nullsafe import safe_div
from shiplens.operators.filters import failed_orders, market, non_null_keys, segment
from shiplens.operators.measures import LINES, count_sum, mean, orders, rate, total
from shiplens.operators.pareto import with_cum_share
from shiplens.operators import scenario as lever


def _by(df: DataFrame, keys, *aggs: Column) -> DataFrame:
    return non_null_keys(df, keys).groupBy(*keys).agg(*aggs)


def lane_col() -> Column:
    is_canada = F.coalesce(F.col("order_region") == CANADA_REGION, F.lit(False))
    return F.when(is_canada, LANE_CROSS_BORDER).otherwise(LANE_DOMESTIC)


def _usca(df: DataFrame) -> DataFrame:
    return market(df).withColumn("lane", lane_col())


# -- K1-K3: OTIF ---------------------------------------------------------------

def otif_by_carrier(df: DataFrame, g=LINES) -> DataFrame:
    return _by(df, ["shipping_mode"],
               orders(g).alias("orders"),
               rate(g, "is_otif").alias("otif_rate"),
               rate(g, "is_on_time").alias("on_time_rate"),
               rate(g, "is_cancelled").alias("cancel_rate"),
               mean(g, "transit_variance_days").alias("avg_transit_variance"),
               mean(g, "cost_per_order").alias("avg_cost_per_order"))


def otif_by_region(df: DataFrame, g=LINES) -> DataFrame:
    return _by(df, ["order_region"],
               orders(g).alias("orders"),
               rate(g, "is_otif").alias("otif_rate"),
               rate(g, "is_on_time").alias("on_time_rate"),
               rate(g, "is_cancelled").alias("cancel_rate"),
               mean(g, "cost_per_order").alias("avg_cost_per_order"))


def otif_monthly(df: DataFrame, g=LINES) -> DataFrame:
    return _by(df, ["order_month"],
               orders(g).alias("orders"),
               rate(g, "is_otif").alias("otif_rate"),
               rate(g, "is_on_time").alias("on_time_rate"))


# -- K4-K5: cost per order, leakage ------------------------------------------

def cpo_region_carrier(df: DataFrame, g=LINES) -> DataFrame:
    return _by(df, ["order_region", "shipping_mode"],
               orders(g).alias("orders"),
               mean(g, "cost_per_order").alias("avg_cost_per_order"),
               total(g, "cost_per_order").alias("total_cost"),
               mean(g, "margin_leakage").alias("avg_margin_leakage"),
               total(g, "margin_leakage").alias("total_margin_leakage"))


def cost_monthly(df: DataFrame, g=LINES) -> DataFrame:
    return _by(df, ["order_month"],
               orders(g).alias("orders"),
               total(g, "cost_per_order").alias("total_shipping_cost"),
               mean(g, "cost_per_order").alias("avg_cost_per_order"),
               total(g, "margin_leakage").alias("total_margin_leakage"))


def cost_by_region(df: DataFrame, g=LINES) -> DataFrame:
    """Region totals over the region x mode cells (K4 re-aggregated: rows
    with a NULL mode are not part of any cell)."""
    cells = non_null_keys(df, ["shipping_mode"])
    return _by(cells, ["order_region"],
               orders(g).alias("orders"),
               total(g, "cost_per_order").alias("total_cost"),
               total(g, "margin_leakage").alias("total_margin_leakage"))


# -- K6: EDD accuracy --------------------------------------------------------

def edd_by_carrier(df: DataFrame, g=LINES) -> DataFrame:
    return _by(df, ["shipping_mode"],
               orders(g).alias("orders"),
               rate(g, "edd_met").alias("edd_met_rate"),
               mean(g, "sched_days").alias("avg_scheduled_days"),
               mean(g, "real_days").alias("avg_real_days"),
               mean(g, "transit_variance_days").alias("avg_variance"))


# -- K7-K9: failed-delivery Pareto --------------------------------------------

def failed_by(df: DataFrame, key: str, g=LINES, cum: bool = True) -> DataFrame:
    agg = _by(failed_orders(df), [key],
              orders(g).alias("failed_orders"),
              total(g, "reshipment_cost").alias("reshipment_cost"))
    return with_cum_share(agg, key) if cum else agg


def failed_delivery_region(df, g=LINES):
    return failed_by(df, "order_region", g)


def failed_delivery_category(df, g=LINES):
    return failed_by(df, "category_name", g)


def failed_delivery_carrier(df, g=LINES):
    return failed_by(df, "shipping_mode", g, cum=False)


# -- K10-K11: cross-border -----------------------------------------------------

def cross_border_summary(df: DataFrame, g=LINES) -> DataFrame:
    return _by(_usca(df), ["lane"],
               orders(g).alias("orders"),
               rate(g, "is_otif").alias("otif_rate"),
               rate(g, "is_on_time").alias("on_time_rate_pre_customs_adj"),
               rate(g, "border_adj_on_time").alias("on_time_rate_post_customs_adj"),
               rate(g, "is_cancelled").alias("cancel_rate"),
               mean(g, "cost_per_order").alias("avg_cost_per_order"),
               mean(g, "sales").alias("avg_sales"))


def cross_border_monthly(df: DataFrame, g=LINES) -> DataFrame:
    return _by(_usca(df), ["order_month", "lane"], orders(g).alias("orders"))


# -- K12-K14: Corporate segment --------------------------------------------------

def corporate_monthly(df: DataFrame, g=LINES) -> DataFrame:
    return _by(segment(df), ["order_month"],
               orders(g).alias("orders"),
               count_sum(g, "qty").alias("total_units"),
               total(g, "sales").alias("total_sales"),
               rate(g, "is_otif").alias("otif_rate"),
               mean(g, "cost_per_order").alias("avg_cost_per_order"))


def corporate_category(df: DataFrame, g=LINES) -> DataFrame:
    return _by(segment(df), ["category_name"],
               orders(g).alias("orders"),
               count_sum(g, "qty").alias("total_units"),
               total(g, "sales").alias("total_sales"),
               rate(g, "is_otif").alias("otif_rate"))


def monthly_by_segment(df: DataFrame, g=LINES) -> DataFrame:
    return _by(df, ["order_month", "customer_segment"], orders(g).alias("orders"))


# -- H1-H6: savings scenario -----------------------------------------------------

def scenario_rows(df: DataFrame, g=LINES, sp: ScenarioParams = DEFAULT_SCENARIO) -> DataFrame:
    """K4 cells with lever A and lever B savings per cell (H1, H2)."""
    cells = cpo_region_carrier(df, g)
    a = lever.lever_a(F.col("total_cost"), sp)
    b = lever.lever_b(F.col("total_cost"), sp)
    return cells.withColumns({
        "savings_carrier_diversification": a,
        "savings_zone_skipping": b,
    }).withColumn("simulated_annual_savings",
                  F.col("savings_carrier_diversification") + F.col("savings_zone_skipping"))


def _cell_cost(g, where: Column | None = None) -> Column:
    return total(g, "cost_per_order", where)


def savings_simulation(df: DataFrame, g=LINES, sp: ScenarioParams = DEFAULT_SCENARIO) -> DataFrame:
    """Per region, current cost and lever A / B savings (H4).

    Levers are linear in cell cost, so the sum over a region's cells equals
    the lever applied to the eligible share of the region's cost: one pass,
    no second aggregation.
    """
    cells = non_null_keys(df, ["order_region", "shipping_mode"])
    out = cells.groupBy("order_region").agg(
        _cell_cost(g).alias("current_total_cost"),
        (_cell_cost(g, lever.lever_a_eligible(sp)) * F.lit(sp.share_a) * F.lit(sp.rate_a))
        .alias("savings_carrier_diversification"),
        lever.lever_b(_cell_cost(g), sp).alias("savings_zone_skipping"),  # region is the key
    )
    out = out.withColumn("simulated_savings",
                         F.col("savings_carrier_diversification") + F.col("savings_zone_skipping"))
    return out.withColumn("savings_pct", safe_div(F.col("simulated_savings"), F.col("current_total_cost")))


def _lever_measures(g, sp: ScenarioParams) -> list[Column]:
    """Global lever totals; ``total_cost_cells`` excludes NULL region/mode."""
    in_cell = F.col("order_region").isNotNull() & F.col("shipping_mode").isNotNull()
    return [
        _cell_cost(g, in_cell).alias("total_cost_cells"),
        (_cell_cost(g, in_cell & lever.lever_a_eligible(sp)) * F.lit(sp.share_a) * F.lit(sp.rate_a))
        .alias("lever_a"),
        (_cell_cost(g, in_cell & lever.lever_b_eligible(sp)) * F.lit(sp.share_b) * F.lit(sp.rate_b))
        .alias("lever_b"),
        lever.lever_c(total(g, "qty_surcharge"), sp).alias("lever_c"),
    ]


def savings_by_lever(df: DataFrame, g=LINES, sp: ScenarioParams = DEFAULT_SCENARIO) -> DataFrame:
    """H5: three rows (lever, annual_savings, pct_of_total_cost)."""
    one = df.agg(*_lever_measures(g, sp))
    long = one.select(
        "total_cost_cells",
        F.col("lever_a").alias(LEVER_A_LABEL),
        F.col("lever_b").alias(LEVER_B_LABEL),
        F.col("lever_c").alias(LEVER_C_LABEL),
    ).unpivot(["total_cost_cells"], [LEVER_A_LABEL, LEVER_B_LABEL, LEVER_C_LABEL],
              "lever", "annual_savings")
    return long.select(
        "lever", "annual_savings",
        safe_div(F.col("annual_savings"), F.col("total_cost_cells")).alias("pct_of_total_cost"))


# -- K19: top-line summary ------------------------------------------------------

def topline_wide(df: DataFrame, g=LINES, sp: ScenarioParams = DEFAULT_SCENARIO) -> DataFrame:
    """All top-line measures in one row, unrounded (one global aggregate)."""
    corp = F.col("customer_segment") == CORPORATE_SEGMENT
    canada = (F.col("market") == USCA_MARKET) & (F.col("order_region") == CANADA_REGION)
    failed = F.col("is_cancelled") == 1
    one = df.agg(
        g.rows().alias("total_orders"),
        g.lo("order_ts").alias("first_order_ts"),
        g.hi("order_ts").alias("last_order_ts"),
        rate(g, "is_otif").alias("otif_rate"),
        rate(g, "is_on_time").alias("on_time_rate"),
        rate(g, "is_cancelled").alias("cancel_rate"),
        mean(g, "cost_per_order").alias("avg_cost_per_order"),
        total(g, "cost_per_order").alias("total_shipping_cost"),
        total(g, "margin_leakage").alias("total_margin_leakage"),
        total(g, "reshipment_cost", failed).alias("total_reshipment_cost"),
        g.rows(corp).alias("corporate_segment_orders"),
        total(g, "sales", corp).alias("corporate_segment_sales"),
        g.rows(canada).alias("usca_cross_border_orders"),
        *_lever_measures(g, sp),
    )
    savings = F.col("lever_a") + F.col("lever_b") + F.col("lever_c")
    return one.withColumns({
        "simulated_annual_savings": savings,
        "simulated_savings_pct": safe_div(savings, F.col("total_cost_cells")),
    })


# Metric names and decimal places of the summary table.
TOPLINE_METRICS = (
    ("total_orders", None),
    ("date_range", None),
    ("otif_rate", 4),
    ("on_time_rate", 4),
    ("cancel_rate", 4),
    ("avg_cost_per_order", 2),
    ("total_shipping_cost", 2),
    ("total_margin_leakage", 2),
    ("total_reshipment_cost", 2),
    ("simulated_annual_savings", 2),
    ("simulated_savings_pct", 4),
    ("corporate_segment_orders", None),
    ("corporate_segment_sales", 2),
    ("usca_cross_border_orders", None),
)


def topline_summary(df: DataFrame, g=LINES, sp: ScenarioParams = DEFAULT_SCENARIO) -> DataFrame:
    """K19 as (metric, value) text rows; values rounded half-even, with a fixed
    number of places (0.4090, not 0.409); a missing value is NULL."""
    wide = topline_wide(df, g, sp)
    cols = []
    for name, dp in TOPLINE_METRICS:
        if name == "date_range":
            c = F.concat(F.date_format("first_order_ts", "yyyy-MM-dd"), F.lit(" to "),
                         F.date_format("last_order_ts", "yyyy-MM-dd"))
        elif dp is None:
            c = F.col(name).cast("string")
        else:
            c = F.when(F.col(name).isNotNull(), F.format_string(f"%.{dp}f", F.bround(F.col(name), dp)))
        cols.append(c.alias(name))
    names = [n for n, _ in TOPLINE_METRICS]
    return wide.select(*cols).unpivot([], names, "metric", "value")
