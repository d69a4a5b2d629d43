"""KPIs on small hand-made inputs with literal expected outputs, and totals and
identities on the test tables. Guards against a fault that the Spark plans and
the SQL oracle share."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shiplens import config
from shiplens.config import CostParams
from shiplens.operators.enrich import enrich
from shiplens.plans import kpis, marts

NO_NOISE = CostParams(noise_sigma=0.0)


def _by(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def four(spark):
    """Four Standard Class lines to Canada and one Same Day line elsewhere."""
    from tests.conftest import LINE_DEFAULTS

    def line(i, **kw):
        from datetime import datetime
        d = {**LINE_DEFAULTS, "line_key": f"L{i}", "order_id": i, "order_region": "Canada", **kw}
        for k in ("order_ts", "ship_ts"):
            d[k] = datetime.fromisoformat(d[k])
        return d
    from tests.conftest import LINE_SCHEMA
    rows = [
        line(1, real_days=2, sched_days=4, qty=1),
        line(2, real_days=4, sched_days=4, qty=3),
        line(3, real_days=6, sched_days=4, qty=1),
        line(4, real_days=3, sched_days=4, qty=1, order_status="CANCELED"),
        line(5, real_days=0, sched_days=0, qty=1, shipping_mode="Same Day", order_region="Atlantis", market="Europe"),
    ]
    names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], LINE_SCHEMA)
    return enrich(df, NO_NOISE).cache()


def test_otif_by_carrier_literal(four):
    got = _by(kpis.otif_by_carrier(four), "shipping_mode")
    std = got["Standard Class"]
    # On time: lines 1, 2, 4. Cancelled: line 4. OTIF: lines 1, 2. Variances: -2, 0, 2, -1.
    assert (std.orders, std.on_time_rate, std.cancel_rate, std.otif_rate) == (4, 0.75, 0.25, 0.5)
    assert std.avg_transit_variance == -0.25
    assert (got["Same Day"].orders, got["Same Day"].otif_rate) == (1, 1.0)


def test_border_day_literal(four):
    lane = _by(kpis.cross_border_summary(four), "lane")
    canada = lane[config.LANE_CROSS_BORDER]
    # One more day for Canada: 3, 5, 7, 4 days against 4 promised, so line 2 is late too.
    assert canada.orders == 4
    assert canada.on_time_rate_pre_customs_adj == 0.75 and canada.on_time_rate_post_customs_adj == 0.5


def test_unknown_region_pays_the_default_zone(four):
    got = _by(four.select("line_key", "zone_factor"), "line_key")
    assert got["L5"].zone_factor == 2.0 and got["L1"].zone_factor == config.ZONE_FACTOR["Canada"]


def test_pareto_literal(spark):
    """Failed lines 5, 3, 2 by region: shares 0.5, 0.8, 1.0."""
    from shiplens.operators.pareto import with_cum_share
    agg = spark.createDataFrame([("A", 3), ("B", 5), ("C", 2)], "k string, failed_orders bigint")
    got = _by(with_cum_share(agg, "k"), "k")
    assert [round(got[k].cum_pct, 9) for k in "BAC"] == [0.5, 0.8, 1.0]


def test_pareto_of_nothing_is_null(spark):
    from shiplens.operators.pareto import with_cum_share
    agg = spark.createDataFrame([("A", 0), ("B", 0)], "k string, failed_orders bigint")
    assert [r.cum_pct for r in with_cum_share(agg, "k").collect()] == [None, None]


def test_lever_literal(four):
    """Lever savings from the stated shares: 40 % x 7 %, 50 % x 22 %, 25 % of surcharge."""
    got = {r.lever: r.annual_savings for r in kpis.savings_by_lever(four).collect()}
    cells = {(r.order_region, r.shipping_mode): r.total_cost for r in kpis.cpo_region_carrier(four).collect()}
    std = cells[("Canada", "Standard Class")]
    same_day = cells[("Atlantis", "Same Day")]
    a = std * ("Standard Class" in config.DIVERSIFIABLE_MODES) + same_day * ("Same Day" in config.DIVERSIFIABLE_MODES)
    assert got["Carrier diversification"] == pytest.approx(a * 0.028)
    assert got["Zone skipping"] == pytest.approx(std * ("Canada" in config.ZONE_SKIP_REGIONS) * 0.11)
    assert got["Packaging optimization"] == pytest.approx(2 * 1.10 * 0.25)  # line 2 has two more units


def test_topline_text_of_no_lines_is_null(four):
    got = {r.metric: r.value for r in kpis.topline_summary(four.where("false")).collect()}
    assert got["total_orders"] == "0" and got["otif_rate"] is None and got["avg_cost_per_order"] is None


def test_card_values_are_literal():
    """A wrong constant would pass the oracle, which reads the same config."""
    assert config.BASE_RATE == {"Standard Class": 6.5, "Second Class": 9.75, "First Class": 14.25, "Same Day": 24.0}
    assert len(config.ZONE_FACTOR) == 23 and "South of  USA" in config.ZONE_FACTOR
    assert config.DIVERSIFIABLE_MODES == ("Standard Class", "Second Class") and len(config.ZONE_SKIP_REGIONS) == 8
    assert len(config.SHIPPED_STATUSES) == 8 and "PAYMENT_REVIEW" not in config.SHIPPED_STATUSES
    assert set(config.CANCELLED_STATUSES) == {"CANCELED", "SUSPECTED_FRAUD"}


def test_surge_literal(spark):
    """Counts 10, 10, 10, 30: mean 15, sample deviation 10, so only 30 is above 25."""
    from shiplens.operators.surge import with_surge
    df = spark.createDataFrame([("m1", 10), ("m2", 10), ("m3", 10), ("m4", 30)], "m string, orders bigint")
    got = _by(with_surge(df), "m")
    assert got["m4"].surge_threshold == 25.0 and [got[m].is_surge for m in ("m1", "m2", "m3", "m4")] == [0, 0, 0, 1]


def test_tables_agree_with_each_other(small_enriched):
    """Identities between KPI tables of the test data."""
    n = small_enriched.count()
    carrier = kpis.otif_by_carrier(small_enriched).collect()
    month = kpis.otif_monthly(small_enriched).collect()
    cells = kpis.cpo_region_carrier(small_enriched).collect()
    top = {r.metric: r.value for r in kpis.topline_summary(small_enriched).collect()}
    assert sum(r.orders for r in carrier) == sum(r.orders for r in month) == n == int(top["total_orders"])
    assert float(top["total_shipping_cost"]) == pytest.approx(sum(r.total_cost for r in cells), abs=0.01)
    assert float(top["otif_rate"]) == pytest.approx(sum(r.otif_rate * r.orders for r in carrier) / n, abs=5e-5)
    surge = {r.order_month for r in marts.surge_months(small_enriched).collect()}
    chart = {r.order_month for r in marts.corporate_surge(small_enriched).collect() if r.is_surge}
    assert surge == chart and surge


def test_key_holding_a_third_of_lines_stays_whole(small_enriched):
    """A third of all lines moved onto one region, mode and month."""
    n = small_enriched.count()
    third = F.pmod(F.xxhash64("line_key"), F.lit(3)) == 0
    hot = small_enriched.withColumns({
        "order_region": F.when(third, "Canada").otherwise(F.col("order_region")),
        "shipping_mode": F.when(third, "Same Day").otherwise(F.col("shipping_mode")),
        "order_month": F.when(third, "1996-01").otherwise(F.col("order_month"))})
    cells = {(r.order_region, r.shipping_mode): r.orders for r in kpis.cpo_region_carrier(hot).collect()}
    assert sum(cells.values()) == n and cells[("Canada", "Same Day")] >= n // 4
    plan = kpis.otif_monthly(hot)._jdf.queryExecution().executedPlan().treeString()
    assert "partial_count" in plan  # combined in each task before the shuffle
