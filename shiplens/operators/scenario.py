"""What-if savings levers as column expressions (no row-wise Python).

Lever A (carrier diversification) and lever B (zone skipping) act on the
total modelled cost of a region x mode cell; lever C (packaging) cuts the
quantity surcharge of every line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiplens.config import DEFAULT_SCENARIO, ScenarioParams


def lever_a_eligible(sp: ScenarioParams = DEFAULT_SCENARIO) -> Column:
    return F.coalesce(F.col("shipping_mode").isin(*sp.diversifiable_modes), F.lit(False))


def lever_b_eligible(sp: ScenarioParams = DEFAULT_SCENARIO) -> Column:
    return F.coalesce(F.col("order_region").isin(*sp.zone_skip_regions), F.lit(False))


def lever_a(cost: Column, sp: ScenarioParams = DEFAULT_SCENARIO) -> Column:
    """Savings from re-bidding a share of diversifiable volume."""
    return F.when(lever_a_eligible(sp), cost * F.lit(sp.share_a) * F.lit(sp.rate_a)).otherwise(F.lit(0.0))


def lever_b(cost: Column, sp: ScenarioParams = DEFAULT_SCENARIO) -> Column:
    """Savings from zone-skipping a share of eligible volume."""
    return F.when(lever_b_eligible(sp), cost * F.lit(sp.share_b) * F.lit(sp.rate_b)).otherwise(F.lit(0.0))


def lever_c(surcharge: Column, sp: ScenarioParams = DEFAULT_SCENARIO) -> Column:
    """Packaging savings on the quantity surcharge."""
    return surcharge * F.lit(sp.rate_c)
