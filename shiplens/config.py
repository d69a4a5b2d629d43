"""Business constants and parameter records.

Everything that must equal the source analysis for right results is kept
here, written out plainly, in the order the analysis states it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the source analysis)
# ---------------------------------------------------------------------------

# Order statuses kept by the shipped-status filter (note: CANCELED and
# SUSPECTED_FRAUD are kept; they become failed deliveries).
SHIPPED_STATUSES = (
    "COMPLETE", "CLOSED", "PENDING_PAYMENT", "PROCESSING",
    "PENDING", "ON_HOLD", "CANCELED", "SUSPECTED_FRAUD",
)
# Statuses that mark a line as cancelled / failed.
CANCELLED_STATUSES = ("CANCELED", "SUSPECTED_FRAUD")
# Delivery status that also marks a line as cancelled.
SHIPPING_CANCELED = "Shipping canceled"

# Base parcel rate ($/shipment) by shipping mode.
BASE_RATE = {
    "Standard Class": 6.50,
    "Second Class": 9.75,
    "First Class": 14.25,
    "Same Day": 24.00,
}

# Zone factor by order region; unknown regions get DEFAULT_ZONE_FACTOR.
# "South of  USA" has two spaces on purpose (exact key of the source data).
ZONE_FACTOR = {
    "US Center": 1.00, "East of USA": 1.05, "West of USA": 1.15, "South of  USA": 1.05,
    "Canada": 1.35, "Central America": 1.45, "Caribbean": 1.55, "South America": 1.75,
    "Western Europe": 2.30, "Northern Europe": 2.40, "Southern Europe": 2.35,
    "Eastern Europe": 2.45, "Southeast Asia": 2.70, "Eastern Asia": 2.75,
    "South Asia": 2.65, "West Asia": 2.50, "Central Asia": 2.55, "Oceania": 2.80,
    "West Africa": 2.60, "North Africa": 2.45, "East Africa": 2.65,
    "Central Africa": 2.70, "Southern Africa": 2.60,
}

# Lever A (carrier diversification) applies to these shipping modes.
DIVERSIFIABLE_MODES = ("Standard Class", "Second Class")
# Lever B (zone skipping) applies to these order regions.
ZONE_SKIP_REGIONS = (
    "West of USA", "East of USA", "South of  USA", "US Center",
    "Canada", "Central America", "Caribbean", "South America",
)

# Cross-border slice.
USCA_MARKET = "USCA"
CANADA_REGION = "Canada"
LANE_CROSS_BORDER = "Cross-border: US DC -> Canada"
LANE_DOMESTIC = "Domestic US"

# Segment slice.
CORPORATE_SEGMENT = "Corporate"

# Lever labels, in report order.
LEVER_A_LABEL = "Carrier diversification"
LEVER_B_LABEL = "Zone skipping"
LEVER_C_LABEL = "Packaging optimization"

# Shipping-mode tier used as the baseline of the tier cost ratio.
BASELINE_TIER = "Standard Class"

# Default timestamp text format of the raw CSV date columns (our assumption;
# the source infers it).
RAW_DATE_FORMAT = "M/d/yyyy H:mm"


@dataclass(frozen=True)
class CostParams:
    """Parcel cost model parameters (fixed values of the source model)."""

    qty_surcharge: float = 1.10      # $ per unit above the first
    noise_sigma: float = 0.6         # invoice-variance noise, N(0, sigma)
    noise_seed: int = 42             # salt of the keyed noise hash
    noise_key: str = "line_key"      # what a draw is indexed by; "_row_no": the row's place in the export
    cost_floor: float = 2.5          # minimum modelled cost
    default_zone_factor: float = 2.0  # zone factor of unknown regions
    target_ratio: float = 0.06       # healthy shipping cost as share of Sales
    base_rate: dict = field(default_factory=lambda: dict(BASE_RATE))
    zone_factor: dict = field(default_factory=lambda: dict(ZONE_FACTOR))

    def __hash__(self):  # dict fields: hash on the scalars only
        return hash((self.qty_surcharge, self.noise_sigma, self.noise_seed,
                     self.cost_floor, self.default_zone_factor, self.target_ratio))


@dataclass(frozen=True)
class ScenarioParams:
    """What-if savings levers (fixed values of the source scenario)."""

    share_a: float = 0.40   # share of diversifiable volume re-bid
    rate_a: float = 0.07    # rate improvement on re-bid volume
    share_b: float = 0.50   # share of eligible volume zone-skipped
    rate_b: float = 0.22    # cost cut on zone-skipped volume
    rate_c: float = 0.25    # packaging cut of the quantity surcharge
    diversifiable_modes: tuple = DIVERSIFIABLE_MODES
    zone_skip_regions: tuple = ZONE_SKIP_REGIONS


DEFAULT_COST = CostParams()
DEFAULT_SCENARIO = ScenarioParams()
