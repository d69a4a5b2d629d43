"""Sanity values stated in FIXTURES.md section 4 (sf0.01, noise sigma 0),
measured there independently of this code."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shiplens.config import CostParams
from shiplens.operators.enrich import enrich
from shiplens.plans import kpis
from shiplens.plans.registry import lines

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plain(spark):
    return enrich(lines(spark, SF), CostParams(noise_sigma=0.0)).cache()


def test_topline_values(plain):
    t = kpis.topline_wide(plain).first()
    assert t.total_orders == 57_012
    assert t.otif_rate == pytest.approx(0.38744, abs=5e-6)
    assert t.on_time_rate == pytest.approx(0.45804, abs=5e-6)
    assert t.cancel_rate == pytest.approx(0.15344, abs=5e-6)
    assert t.avg_cost_per_order == pytest.approx(27.8509, abs=5e-5)
    assert t.total_shipping_cost == pytest.approx(1_587_836.46, abs=5e-3)
    assert t.total_margin_leakage == pytest.approx(1_036_465.79, abs=5e-3)
    assert t.total_reshipment_cost == pytest.approx(241_570.84, abs=5e-3)
    assert t.lever_c == pytest.approx(31_358.25, abs=5e-3)


def test_failed_and_cross_border_values(plain):
    failed = kpis.failed_delivery_region(plain).agg(F.sum("failed_orders"), F.count("*")).first()
    assert tuple(failed) == (8_748, 25)
    cb = {r.lane: r for r in kpis.cross_border_summary(plain).collect()}
    assert sum(r.orders for r in cb.values()) == 11_411
    canada = cb["Cross-border: US DC -> Canada"]
    assert canada.orders == 2_106
    assert canada.on_time_rate_pre_customs_adj == pytest.approx(0.47293, abs=5e-6)
    assert canada.on_time_rate_post_customs_adj == pytest.approx(0.32289, abs=5e-6)
