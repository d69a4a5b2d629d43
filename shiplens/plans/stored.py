"""Charts, dashboard cards and workbook sheets from stored KPI tables alone.

Every view reads the tables it names (through their declarations, see
``sources/contracts.py``) and nothing else: no order lines, no cube. Stored
values are rounded (amounts to 4, ratios to 6 decimals); a view derived from
them equals the direct query up to that rounding. Counts that a sheet derives
from a rate and the orders are whole numbers.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiplens.operators.reshape import relabel
from shiplens.plans import marts, registry
from shiplens.sources.publish import published
from shiplens.sources.sinks import read_kpi

Read = Callable[[str], DataFrame]


def _counted(rate: str, orders: str = "orders"):
    return F.bround(F.col(rate) * F.col(orders)).cast("long")


def _carrier_sheet(read: Read) -> DataFrame:
    k1 = read("kpi_otif_by_carrier")
    return marts.carrier_sheet(k1.select(
        "shipping_mode", "orders", _counted("otif_rate").alias("otif_orders"), _counted("on_time_rate").alias("on_time_orders"),
        _counted("cancel_rate").alias("cancelled_orders"), F.bround("avg_transit_variance", 2).alias("avg_transit_variance"),
        F.bround("avg_cost_per_order", 2).alias("avg_cost_per_order")))


def _edd_sheet(read: Read) -> DataFrame:
    k6 = read("kpi_edd_by_carrier")
    return marts.edd_sheet(k6.select(
        "shipping_mode", "orders", _counted("edd_met_rate").alias("edd_met_orders"),
        *[F.bround(c, 2).alias(c) for c in ("avg_scheduled_days", "avg_real_days", "avg_variance")]))


def _pareto_sheet(read: Read) -> DataFrame:
    def block(table: str, key: str, label: str) -> DataFrame:
        return read(table).select(F.lit(label).alias("dimension"), F.col(key).alias("key"), "failed_orders", "reshipment_cost")

    return marts.pareto_sheet(block("kpi_failed_delivery_region", "order_region", "By Region").unionByName(
        block("kpi_failed_delivery_category", "category_name", "By Category")))


def _summary(read: Read) -> DataFrame:
    return marts.summary_from_stored(read("kpi_topline_summary"))


#: View (a query's name) -> how it is built from stored tables.
VIEWS: dict[str, Callable[[Read], DataFrame]] = {
    "chart_otif_by_carrier": lambda read: marts.otif_chart(read("kpi_otif_by_carrier")),
    "chart_otif_monthly": lambda read: marts.monthly_chart(read("kpi_otif_monthly")),
    "chart_cost_by_region": lambda read: marts.cost_by_region(read("kpi_cpo_region_carrier")),
    "chart_leakage_by_region": lambda read: marts.leakage_by_region(read("kpi_cpo_region_carrier")),
    "chart_edd_by_carrier": lambda read: marts.edd_chart(read("kpi_edd_by_carrier")),
    "chart_pareto_region": lambda read: marts.pareto_chart(read("kpi_failed_delivery_region"), "order_region"),
    "chart_pareto_category": lambda read: marts.pareto_chart(read("kpi_failed_delivery_category"), "category_name"),
    "chart_cross_border": lambda read: marts.cross_border_chart(read("kpi_cross_border_summary")),
    "chart_corporate_surge": lambda read: marts.surge_chart(read("kpi_corporate_monthly")),
    "chart_corporate_mix": lambda read: marts.mix_chart(read("kpi_corporate_category")),
    "chart_savings_by_lever": lambda read: marts.lever_chart(read("kpi_savings_by_lever")),
    "dashboard_cards": lambda read: marts.cards(_summary(read)),
    "wb_topline": lambda read: marts.topline_sheet(_summary(read)),
    "wb_otif_by_carrier": _carrier_sheet,
    "wb_edd_by_carrier": _edd_sheet,
    "wb_pareto": _pareto_sheet,
    "wb_savings_by_lever": lambda read: marts.lever_sheet(read("kpi_savings_by_lever")),
    # Sheets that list a stored table as it is.
    **{t: (lambda read, _t=t: read(_t)) for t in (
        "kpi_otif_by_region", "kpi_cpo_region_carrier", "kpi_cross_border_summary", "kpi_corporate_monthly",
        "kpi_corporate_category", "kpi_savings_simulation")},
}


def reader(spark: SparkSession, out_dir: str, fmt: str = "parquet") -> Read:
    """Tables of the newest published run of the batch job, each checked."""
    tables = published(spark, out_dir)
    return lambda name: read_kpi(spark, tables[name], fmt, name=name)


def view(name: str, read: Read) -> DataFrame:
    return registry.present(VIEWS[name](read), registry.QUERIES[name])


def sheet(title: str, read: Read) -> DataFrame:
    """A workbook sheet under its display labels."""
    name, labels = marts.WORKBOOK_SHEETS[title]
    return relabel(view(name, read), labels)
