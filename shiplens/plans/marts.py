"""Chart, dashboard and workbook datasets built from the KPI tables.

The source drew pictures and spreadsheet cells from these numbers; here
each picture or sheet becomes the DataFrame it plots or lists (unit
scaling, top-N, re-aggregation, long form, total rows, derived counts and
rates). Inputs are the enriched lines (or the cube); outputs are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiplens.config import DEFAULT_SCENARIO
from shiplens.functions.nullsafe import safe_div
from shiplens.functions.numeric import AMOUNT_DP, RATIO_DP
from shiplens.functions.text import count_text, money_text, pct_text, thousands_text
from shiplens.operators.measures import LINES
from shiplens.operators.pareto import pareto_order, with_cum_share, with_vital_few
from shiplens.operators.surge import with_surge
from shiplens.plans import kpis

PCT = 100.0


def _top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


# -- charts -------------------------------------------------------------------

def chart_otif_by_carrier(df, g=LINES):
    """Tier OTIF % with the unweighted network-average line and axis bound."""
    return otif_chart(kpis.otif_by_carrier(df, g))


def otif_chart(k1: DataFrame) -> DataFrame:
    whole = Window.partitionBy()
    return k1.select(
        "shipping_mode", "orders",
        (F.col("otif_rate") * PCT).alias("otif_pct"),
        (F.avg("otif_rate").over(whole) * PCT).alias("network_avg_pct"),
        (F.max("otif_rate").over(whole) * PCT + 12).alias("axis_max_pct"),
        pct_text(F.col("otif_rate")).alias("label"))


def chart_otif_monthly(df, g=LINES):
    return monthly_chart(kpis.otif_monthly(df, g))


def monthly_chart(k3: DataFrame) -> DataFrame:
    return k3.select(
        "order_month",
        F.to_date("order_month", "yyyy-MM").cast("string").alias("month_start"),
        (F.col("otif_rate") * PCT).alias("otif_pct"),
        (F.col("on_time_rate") * PCT).alias("on_time_pct"))


def chart_cost_by_region(df, g=LINES, n: int = 12):
    return _cost_chart(kpis.cost_by_region(df, g), n)


def cost_by_region(cells: DataFrame, n: int = 12) -> DataFrame:
    """The same chart from the stored region x carrier table."""
    return _cost_chart(cells.groupBy("order_region").agg(
        F.sum("orders").alias("orders"), F.sum("total_cost").alias("total_cost")), n)


def _cost_chart(regions: DataFrame, n: int) -> DataFrame:
    regions = regions.select(
        "order_region", "orders", "total_cost",
        safe_div(F.col("total_cost"), F.col("orders")).alias("avg_cpo"),
        (F.col("total_cost") / 1000).alias("total_cost_k"),
        thousands_text(F.col("total_cost")).alias("label"))
    return _top(regions, n, F.col("total_cost").desc(), F.col("order_region").asc())


def chart_leakage_by_region(df, g=LINES, n: int = 10):
    return _leakage_chart(kpis.cost_by_region(df, g), n)


def leakage_by_region(cells: DataFrame, n: int = 10) -> DataFrame:
    """The same chart from the stored region x carrier table."""
    return _leakage_chart(cells.groupBy("order_region").agg(
        F.sum("total_margin_leakage").alias("total_margin_leakage")), n)


def _leakage_chart(regions: DataFrame, n: int) -> DataFrame:
    regions = regions.select(
        "order_region", "total_margin_leakage",
        (F.col("total_margin_leakage") / 1000).alias("total_margin_leakage_k"),
        thousands_text(F.col("total_margin_leakage")).alias("label"))
    return _top(regions, n, F.col("total_margin_leakage").desc(), F.col("order_region").asc())


def chart_edd_by_carrier(df, g=LINES):
    return edd_chart(kpis.edd_by_carrier(df, g))


def edd_chart(k6: DataFrame) -> DataFrame:
    return k6.select(
        "shipping_mode", (F.col("edd_met_rate") * PCT).alias("edd_met_pct"), "avg_variance",
        pct_text(F.col("edd_met_rate")).alias("label"))


def chart_pareto(df, key: str, g=LINES, n: int = 10):
    return pareto_chart(kpis.failed_by(df, key, g), key, n)


def pareto_chart(p: DataFrame, key: str, n: int = 10) -> DataFrame:
    top = _top(p, n, *pareto_order(key, "failed_orders"))
    return top.select(key, "failed_orders", (F.col("cum_pct") * PCT).alias("cum_pct_100"))


def chart_pareto_region(df, g=LINES):
    return chart_pareto(df, "order_region", g)


def chart_pareto_category(df, g=LINES):
    return chart_pareto(df, "category_name", g)


def pareto_vital_few(df, g=LINES, cut: float = 0.8):
    return with_vital_few(kpis.failed_delivery_region(df, g), cut)


CROSS_BORDER_METRICS = ("otif_rate", "on_time_rate_post_customs_adj", "cancel_rate")


def chart_cross_border(df, g=LINES):
    """Lane x 3 rates in long form, in percent."""
    return cross_border_chart(kpis.cross_border_summary(df, g))


def cross_border_chart(k10: DataFrame) -> DataFrame:
    long = k10.select("lane", *CROSS_BORDER_METRICS).unpivot(["lane"], list(CROSS_BORDER_METRICS), "metric", "rate")
    return long.select("lane", "metric", (F.col("rate") * PCT).alias("value_pct"),
                       pct_text(F.col("rate")).alias("label"))


def corporate_surge(df, g=LINES, k: float = 1.0):
    """Corporate monthly orders with the mean + k*std threshold and flag."""
    return surge_chart(kpis.corporate_monthly(df, g), k)


def surge_chart(k12: DataFrame, k: float = 1.0) -> DataFrame:
    return with_surge(k12.select("order_month", "orders"), "orders", k)


def surge_months(df, g=LINES, k: float = 1.0):
    return corporate_surge(df, g, k).where(F.col("is_surge") == 1)


def chart_corporate_mix(df, g=LINES, n: int = 8):
    """Top Corporate categories by order count (plotted value: units)."""
    return mix_chart(kpis.corporate_category(df, g), n)


def mix_chart(k13: DataFrame, n: int = 8) -> DataFrame:
    return _top(k13, n, F.col("orders").desc(), F.col("category_name").asc()).select(
        "category_name", "orders", "total_units")


def chart_savings_by_lever(df, g=LINES, sp=DEFAULT_SCENARIO):
    return lever_chart(kpis.savings_by_lever(df, g, sp))


def lever_chart(lv: DataFrame) -> DataFrame:
    return lv.select(
        "lever", "annual_savings", "pct_of_total_cost",
        (F.col("annual_savings") / 1000).alias("annual_savings_k"),
        F.concat(thousands_text(F.col("annual_savings")), F.lit(" ("),
                 pct_text(F.col("pct_of_total_cost")), F.lit(")")).alias("label"))


# -- dashboard ------------------------------------------------------------------

def _summary_rounded(df, g=LINES, sp=DEFAULT_SCENARIO):
    """Top-line values as the summary table holds them (rounded half-even)."""
    w = kpis.topline_wide(df, g, sp)
    cols = []
    for name, dp in kpis.TOPLINE_METRICS:
        if name == "date_range":
            continue
        cols.append((F.col(name) if dp is None else F.bround(F.col(name), dp)).alias(name))
    return w.select(*cols)


# Card order and labels.
CARD_LABELS = (
    "Total Orders Analyzed",
    "OTIF Rate",
    "Avg. Cost per Order",
    "Total Outbound Shipping Cost",
    "Margin Leakage Identified",
    "Reshipment Cost (Failed Deliveries)",
    "Simulated Annual Savings",
    "Cross-Border (USCA) Orders",
)


def dashboard_cards(df, g=LINES, sp=DEFAULT_SCENARIO):
    """Eight (card, label, value text) rows from the top-line summary."""
    return cards(_summary_rounded(df, g, sp))


def summary_from_stored(stored: DataFrame) -> DataFrame:
    """The stored (metric, value) summary as one row of numbers."""
    names = [name for name, _ in kpis.TOPLINE_METRICS if name != "date_range"]
    return stored.agg(*[F.max(F.when(F.col("metric") == n, F.col("value").try_cast("double"))).alias(n) for n in names])


def cards(s: DataFrame) -> DataFrame:
    """The cards of a one-row summary."""
    texts = [
        count_text(F.col("total_orders")),
        pct_text(F.col("otif_rate")),
        money_text(F.col("avg_cost_per_order")),
        money_text(F.col("total_shipping_cost")),
        money_text(F.col("total_margin_leakage")),
        money_text(F.col("total_reshipment_cost")),
        F.concat(money_text(F.col("simulated_annual_savings")), F.lit(" ("),
                 pct_text(F.col("simulated_savings_pct")), F.lit(")")),
        count_text(F.col("usca_cross_border_orders")),
    ]
    cards = F.array(*[
        F.struct(F.lit(i + 1).alias("card"), F.lit(lbl).alias("label"), t.alias("value"))
        for i, (lbl, t) in enumerate(zip(CARD_LABELS, texts))
    ])
    return s.select(F.inline(cards))


# -- workbook -------------------------------------------------------------------

def wb_topline(df, g=LINES, sp=DEFAULT_SCENARIO):
    """Topline sheet: 11 inputs (three counts derived from rounded rates), as
    amounts, and six derived ratios, as (metric, value) rows."""
    return topline_sheet(_summary_rounded(df, g, sp))


def topline_sheet(s: DataFrame) -> DataFrame:
    """The sheet of a one-row summary."""
    n = F.col("total_orders").cast("double")
    derived_count = lambda r: F.bround(F.col(r) * n, 0)
    # The sheet's metric labels, here and in ``derived``.
    inputs = {
        "Total Orders Analyzed": n,
        "OTIF Orders (derived)": derived_count("otif_rate"),
        "On-Time Orders (derived)": derived_count("on_time_rate"),
        "Cancelled Orders (derived)": derived_count("cancel_rate"),
        "Total Outbound Shipping Cost ($)": F.col("total_shipping_cost"),
        "Total Shipping Margin Leakage ($)": F.col("total_margin_leakage"),
        "Total Reshipment Cost ($, cancelled orders)": F.col("total_reshipment_cost"),
        "Simulated Annual Savings ($, 3 levers)": F.col("simulated_annual_savings"),
        "Corporate (B2B) Segment Orders": F.col("corporate_segment_orders").cast("double"),
        "Corporate (B2B) Segment Sales ($)": F.col("corporate_segment_sales"),
        "Cross-Border US->Canada Orders": F.col("usca_cross_border_orders").cast("double"),
    }
    step = s.select(*[c.alias(k) for k, c in inputs.items()])
    c = lambda k: F.col(f"`{k}`")
    derived = {
        "OTIF Rate": safe_div(c("OTIF Orders (derived)"), c("Total Orders Analyzed")),
        "On-Time Rate": safe_div(c("On-Time Orders (derived)"), c("Total Orders Analyzed")),
        "Cancellation Rate": safe_div(c("Cancelled Orders (derived)"), c("Total Orders Analyzed")),
        "Avg. Cost per Order": safe_div(c("Total Outbound Shipping Cost ($)"), c("Total Orders Analyzed")),
        "Margin Leakage as % of Total Cost": safe_div(c("Total Shipping Margin Leakage ($)"),
                                                      c("Total Outbound Shipping Cost ($)")),
        "Simulated Savings as % of Total Cost": safe_div(c("Simulated Annual Savings ($, 3 levers)"),
                                                         c("Total Outbound Shipping Cost ($)")),
    }
    full = step.select("*", *[v.alias(k) for k, v in derived.items()])
    names = list(inputs) + list(derived)
    block = ["input"] * len(inputs) + ["derived"] * len(derived)
    places = {"input": AMOUNT_DP, "derived": RATIO_DP}
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("row_no"), F.lit(b).alias("block"), F.lit(k).alias("metric"),
                 F.round(c(k), places[b]).alias("value"))
        for i, (k, b) in enumerate(zip(names, block))
    ])
    return full.select(F.inline(rows))


# Fixed value: label of the carrier sheet's total row.
TOTAL_LABEL = "TOTAL / NETWORK AVG"


def wb_otif_by_carrier(df, g=LINES):
    """Carrier sheet: counts, rates from counts, 2-dp averages, a total row
    (orders, OTIF orders and the order-weighted OTIF rate)."""
    from shiplens.operators.filters import non_null_keys
    from shiplens.operators.measures import mean, orders

    detail = non_null_keys(df, ["shipping_mode"]).groupBy("shipping_mode").agg(
        orders(g).alias("orders"),
        g.s("is_otif").cast("long").alias("otif_orders"),
        g.s("is_on_time").cast("long").alias("on_time_orders"),
        g.s("is_cancelled").cast("long").alias("cancelled_orders"),
        F.bround(mean(g, "transit_variance_days"), 2).alias("avg_transit_variance"),
        F.bround(mean(g, "cost_per_order"), 2).alias("avg_cost_per_order"),
    )
    return carrier_sheet(detail)


def carrier_sheet(detail: DataFrame) -> DataFrame:
    """Counts per tier with their total row, and the rates of both."""
    from shiplens.operators.reshape import with_total_row

    out = with_total_row(detail, "shipping_mode", TOTAL_LABEL, ("orders", "otif_orders"))
    return out.withColumns({
        "otif_rate": safe_div(F.col("otif_orders"), F.col("orders")),
        "on_time_rate": safe_div(F.col("on_time_orders"), F.col("orders")),
        "cancel_rate": safe_div(F.col("cancelled_orders"), F.col("orders")),
    })


def wb_edd_by_carrier(df, g=LINES):
    from shiplens.operators.filters import non_null_keys
    from shiplens.operators.measures import mean, orders

    out = non_null_keys(df, ["shipping_mode"]).groupBy("shipping_mode").agg(
        orders(g).alias("orders"),
        g.s("edd_met").cast("long").alias("edd_met_orders"),
        F.bround(mean(g, "sched_days"), 2).alias("avg_scheduled_days"),
        F.bround(mean(g, "real_days"), 2).alias("avg_real_days"),
        F.bround(mean(g, "transit_variance_days"), 2).alias("avg_variance"),
    )
    return edd_sheet(out)


def edd_sheet(detail: DataFrame) -> DataFrame:
    return detail.withColumn("edd_met_rate", safe_div(F.col("edd_met_orders"), F.col("orders")))


def wb_pareto(df, g=LINES):
    """Region and category Pareto blocks stacked with a dimension label.

    Both blocks come from one scan of the failed lines: a grouping-sets
    aggregate ((region), (category)), then a running share per block.
    """
    from shiplens.operators.measures import orders, total

    failed = df.where(F.col("is_cancelled") == 1)
    agg = failed.groupingSets([["order_region"], ["category_name"]], "order_region", "category_name").agg(
        F.grouping("order_region").alias("_g_region"),
        orders(g).alias("failed_orders"),
        total(g, "reshipment_cost").alias("reshipment_cost"))
    by_region = F.col("_g_region") == 0
    blocks = agg.select(
        F.when(by_region, F.lit("By Region")).otherwise(F.lit("By Category")).alias("dimension"),
        F.when(by_region, F.col("order_region")).otherwise(F.col("category_name")).alias("key"),
        "failed_orders", "reshipment_cost").where(F.col("key").isNotNull())
    return pareto_sheet(blocks)


def pareto_sheet(blocks: DataFrame) -> DataFrame:
    """Stacked blocks (dimension, key, failed_orders, reshipment_cost) with their running shares."""
    return with_cum_share(blocks, "key", by=("dimension",)).select(
        "dimension", "key", "failed_orders", F.bround(F.col("reshipment_cost"), 2).alias("reshipment_cost"), "cum_pct")


def wb_savings_by_lever(df, g=LINES, sp=DEFAULT_SCENARIO):
    return lever_sheet(kpis.savings_by_lever(df, g, sp))


def lever_sheet(lv: DataFrame) -> DataFrame:
    from shiplens.operators.reshape import with_total_row

    return with_total_row(lv, "lever", "TOTAL", ("annual_savings",))


# Workbook sheet names and column display labels.
WORKBOOK_SHEETS = {
    "Topline KPIs": ("wb_topline", {"metric": "Metric", "value": "Value"}),
    "OTIF by Carrier": ("wb_otif_by_carrier", {
        "shipping_mode": "Carrier / Service Tier", "orders": "Orders", "otif_orders": "OTIF Orders",
        "on_time_orders": "On-Time Orders", "cancelled_orders": "Cancelled Orders",
        "avg_transit_variance": "Avg Transit Variance (days)", "avg_cost_per_order": "Avg Cost/Order ($)",
        "otif_rate": "OTIF Rate", "on_time_rate": "On-Time Rate", "cancel_rate": "Cancel Rate"}),
    "OTIF by Region": ("kpi_otif_by_region", {
        "order_region": "Order Region", "orders": "Orders", "otif_rate": "OTIF Rate",
        "on_time_rate": "On-Time Rate", "cancel_rate": "Cancel Rate",
        "avg_cost_per_order": "Avg Cost/Order ($)"}),
    "Cost per Order": ("kpi_cpo_region_carrier", {
        "order_region": "Order Region", "shipping_mode": "Carrier", "orders": "Orders",
        "avg_cost_per_order": "Avg Cost/Order ($)", "total_cost": "Total Cost ($)",
        "avg_margin_leakage": "Avg Margin Leakage ($)", "total_margin_leakage": "Total Margin Leakage ($)"}),
    "EDD Accuracy": ("wb_edd_by_carrier", {
        "shipping_mode": "Carrier", "orders": "Orders", "edd_met_orders": "EDD Met Orders",
        "avg_scheduled_days": "Avg Scheduled Days", "avg_real_days": "Avg Real Days",
        "avg_variance": "Avg Variance (days)", "edd_met_rate": "EDD Met Rate"}),
    "Failed Delivery Pareto": ("wb_pareto", {
        "dimension": "Block", "key": "Key", "failed_orders": "Failed Orders",
        "reshipment_cost": "Reshipment Cost ($)", "cum_pct": "Cumulative %"}),
    "Cross-Border USCA": ("kpi_cross_border_summary", {
        "lane": "Lane", "orders": "Orders", "otif_rate": "OTIF Rate",
        "on_time_rate_pre_customs_adj": "On-Time Rate (Pre-Customs)",
        "on_time_rate_post_customs_adj": "On-Time Rate (Post-Customs)", "cancel_rate": "Cancel Rate",
        "avg_cost_per_order": "Avg Cost/Order ($)", "avg_sales": "Avg Sales ($)"}),
    "Corporate Monthly": ("kpi_corporate_monthly", {
        "order_month": "Month", "orders": "Orders", "total_units": "Total Units",
        "total_sales": "Total Sales ($)", "otif_rate": "OTIF Rate", "avg_cost_per_order": "Avg Cost/Order ($)"}),
    "Corporate Category": ("kpi_corporate_category", {
        "category_name": "Category", "orders": "Orders", "total_units": "Total Units",
        "total_sales": "Total Sales ($)", "otif_rate": "OTIF Rate"}),
    "Savings by Lever": ("wb_savings_by_lever", {
        "lever": "Lever", "annual_savings": "Annual Savings ($)", "pct_of_total_cost": "% of Total Cost"}),
    "Savings by Region": ("kpi_savings_simulation", {
        "order_region": "Order Region", "current_total_cost": "Current Cost ($)",
        "savings_carrier_diversification": "Savings: Carrier Diversification ($)",
        "savings_zone_skipping": "Savings: Zone Skipping ($)",
        "simulated_savings": "Total Simulated Savings ($)", "savings_pct": "Savings %"}),
}
