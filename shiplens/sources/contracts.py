"""Declared schema and key of every stored KPI table.

A reader that names its table gets it held to this declaration: a renamed,
missing or retyped column, or a key that occurs twice, fails with the table's
name instead of giving a wrong chart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Table -> (columns in order, key columns).
CONTRACTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "kpi_otif_by_carrier": (
        "shipping_mode string, orders bigint, otif_rate double, on_time_rate double, cancel_rate double, "
        "avg_transit_variance double, avg_cost_per_order double", ("shipping_mode",)),
    "kpi_otif_by_region": (
        "order_region string, orders bigint, otif_rate double, on_time_rate double, cancel_rate double, "
        "avg_cost_per_order double", ("order_region",)),
    "kpi_otif_monthly": (
        "order_month string, orders bigint, otif_rate double, on_time_rate double", ("order_month",)),
    "kpi_cpo_region_carrier": (
        "order_region string, shipping_mode string, orders bigint, avg_cost_per_order double, total_cost double, "
        "avg_margin_leakage double, total_margin_leakage double", ("order_region", "shipping_mode")),
    "kpi_cost_monthly": (
        "order_month string, orders bigint, total_shipping_cost double, avg_cost_per_order double, "
        "total_margin_leakage double", ("order_month",)),
    "kpi_edd_by_carrier": (
        "shipping_mode string, orders bigint, edd_met_rate double, avg_scheduled_days double, avg_real_days double, "
        "avg_variance double", ("shipping_mode",)),
    "kpi_failed_delivery_region": (
        "order_region string, failed_orders bigint, reshipment_cost double, cum_pct double", ("order_region",)),
    "kpi_failed_delivery_category": (
        "category_name string, failed_orders bigint, reshipment_cost double, cum_pct double", ("category_name",)),
    "kpi_failed_delivery_carrier": (
        "shipping_mode string, failed_orders bigint, reshipment_cost double", ("shipping_mode",)),
    "kpi_cross_border_summary": (
        "lane string, orders bigint, otif_rate double, on_time_rate_pre_customs_adj double, "
        "on_time_rate_post_customs_adj double, cancel_rate double, avg_cost_per_order double, avg_sales double", ("lane",)),
    "kpi_cross_border_monthly": ("order_month string, lane string, orders bigint", ("order_month", "lane")),
    "kpi_corporate_monthly": (
        "order_month string, orders bigint, total_units bigint, total_sales double, otif_rate double, "
        "avg_cost_per_order double", ("order_month",)),
    "kpi_corporate_category": (
        "category_name string, orders bigint, total_units bigint, total_sales double, otif_rate double", ("category_name",)),
    "kpi_monthly_by_segment": (
        "order_month string, customer_segment string, orders bigint", ("order_month", "customer_segment")),
    "kpi_savings_simulation": (
        "order_region string, current_total_cost double, savings_carrier_diversification double, "
        "savings_zone_skipping double, simulated_savings double, savings_pct double", ("order_region",)),
    "kpi_savings_by_lever": ("lever string, annual_savings double, pct_of_total_cost double", ("lever",)),
    "kpi_topline_summary": ("metric string, value string", ("metric",)),
}


class ContractError(ValueError):
    """A stored table does not fit its declaration."""


def columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in CONTRACTS[name][0].split(", ")]


def check_columns(name: str, found: list[str], types: dict[str, str] | None = None) -> None:
    """Raise if ``found`` (and, where given, its types) is not as declared."""
    want = columns(name)
    missing = [c for c, _ in want if c not in found]
    extra = [c for c in found if c not in dict(want)]
    if missing or extra:
        raise ContractError(f"{name}: columns missing {missing}, not declared {extra}")
    wrong = {c: types[c] for c, t in want if types is not None and types[c] != t}
    if wrong:
        raise ContractError(f"{name}: columns of another type than declared: {wrong}")


def check_key(name: str, df: DataFrame) -> None:
    """Raise if a key is null or occurs twice. Reads the table's keys."""
    keys = CONTRACTS[name][1]
    bad = (df.groupBy(*keys).count().where((F.col("count") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
           .limit(1).collect())
    if bad:
        raise ContractError(f"{name}: key {keys} is null or repeated: {bad[0].asDict()}")
