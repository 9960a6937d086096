"""Model constants. All numbers are fixed values of the risk method."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RainWeights:
    # fixed values: weight and saturation depth (mm) per rainfall window
    w24: float = 0.40
    w72: float = 0.35
    w7d: float = 0.25
    t24: float = 75.0
    t72: float = 100.0
    t7d: float = 150.0


@dataclass(frozen=True)
class RiskWeights:
    # fixed values: static, dynamic and interaction weight
    static: float = 0.50
    dynamic: float = 0.30
    interaction: float = 0.20


# fixed values: lower edges, highest tier first
RISK_TIERS = (("Very High", 0.75), ("High", 0.55), ("Moderate", 0.35))
SUSCEPTIBILITY_TIERS = (("Very High", 0.70), ("High", 0.50), ("Moderate", 0.35))
MICRO_TIERS = (("Extreme", 0.80), ("Very High", 0.70), ("High", 0.50), ("Moderate", 0.35))
TIER_ORDER = ("Low", "Moderate", "High", "Very High")
ALERT_FLOOR = 0.55
ALERT_VERY_HIGH = 0.75


@dataclass(frozen=True)
class Horizon:
    name: str
    hours: int
    column: str  # cumulative forecast depth (mm) until this lead time


HORIZONS = (
    Horizon("+6h", 6, "c6"),
    Horizon("+12h", 12, "c12"),
    Horizon("+24h", 24, "c24"),
    Horizon("+48h", 48, "c48"),
)

# fixed values: scenario multiplier of the trigger index per lead time
SCENARIO = {"+6h": 1.15, "+12h": 1.45, "+24h": 1.85, "+48h": 1.60}

# fixed values: metres per degree of the local planar frame
METRES_PER_DEG_LON = 98500.0
METRES_PER_DEG_LAT = 111000.0

# fixed values: WGS84 semi-major axis (m) and first eccentricity squared
WGS84_A = 6378137.0
WGS84_E2 = 0.00669437999014

# fixed values: land-cover class names
LAND_COVER = {
    10: "Tree cover",
    20: "Shrubland",
    30: "Grassland",
    40: "Cropland",
    50: "Built-up",
    60: "Bare / sparse vegetation",
    70: "Snow and ice",
    80: "Permanent water bodies",
    90: "Herbaceous wetland",
    95: "Mangroves",
    100: "Moss and lichen",
}


@dataclass(frozen=True)
class GridMeta:
    """Regular north-up raster: origin is the north-west corner."""

    lon0: float
    lat0: float
    dx: float
    dy: float
    width: int
    height: int
    nodata: float | None = -9999.0


@dataclass(frozen=True)
class Axis:
    """Regular axis of cell centres."""

    start: float
    step: float
    size: int


@dataclass(frozen=True)
class Box:
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float


@dataclass(frozen=True)
class Refinement:
    # fixed values of the two-level grid
    always: float = 0.70
    steep: float = 0.50
    slope: float = 30.0
    min_parents: int = 50
    fallback_top: int = 100
    per_side: int = 10
    half_width: float = 0.00045
