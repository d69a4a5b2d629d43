"""Invariants of the enriched lines and KPI tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shiplens.plans import kpis, marts


def test_flag_invariants(small_enriched):
    bad = small_enriched.where(
        (F.col("is_otif") > F.col("is_on_time"))
        | (F.col("edd_met") != F.col("is_on_time"))
        | (F.col("is_in_full") + F.col("is_cancelled") != 1)
        | (F.col("margin_leakage") < 0)
        | (F.col("modeled_shipping_cost") < 2.5)
        | (F.col("border_adj_on_time") > F.col("is_on_time")))
    assert bad.count() == 0


def test_group_orders_sum_to_lines(small_enriched):
    n = small_enriched.count()
    for fn in (kpis.otif_by_carrier, kpis.otif_by_region, kpis.otif_monthly, kpis.monthly_by_segment):
        assert fn(small_enriched).agg(F.sum("orders")).first()[0] == n


def test_pareto_running_share(small_enriched):
    for key in ("order_region", "category_name"):
        rows = kpis.failed_by(small_enriched, key).orderBy(F.desc("failed_orders"), key).collect()
        shares = [r.cum_pct for r in rows]
        assert shares == sorted(shares) and shares[-1] == pytest.approx(1.0)


def test_lever_rows_sum_to_topline(small_enriched):
    lv = kpis.savings_by_lever(small_enriched).agg(F.sum("annual_savings")).first()[0]
    top = kpis.topline_wide(small_enriched).first()
    assert lv == pytest.approx(top.simulated_annual_savings)
    sim = kpis.savings_simulation(small_enriched).agg(F.sum("simulated_savings")).first()[0]
    assert sim == pytest.approx(top.lever_a + top.lever_b)


def test_total_row_rate_is_global_rate(small_enriched):
    wb = {r.shipping_mode: r for r in marts.wb_otif_by_carrier(small_enriched).collect()}
    total = wb[marts.TOTAL_LABEL]
    assert total.otif_rate == pytest.approx(kpis.topline_wide(small_enriched).first().otif_rate)


def test_post_customs_on_time_not_above_pre(small_enriched):
    for r in kpis.cross_border_summary(small_enriched).collect():
        assert r.on_time_rate_post_customs_adj <= r.on_time_rate_pre_customs_adj


def test_top_k_sizes(small_enriched):
    assert marts.chart_cost_by_region(small_enriched).count() == 12
    assert marts.chart_leakage_by_region(small_enriched).count() == 10
    assert marts.chart_corporate_mix(small_enriched).count() <= 8
