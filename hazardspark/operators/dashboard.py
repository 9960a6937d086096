"""Aggregates behind the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardspark.functions.tiers import tier_bucket
from hazardspark.operators.ordering import side_by_side
from hazardspark.operators.quality import to_number

# fixed values: display buckets, mildest first
BUCKETS = ("LOW", "MODERATE", "HIGH", "VERY HIGH")
LAT_NAMES = ("latitude", "lat", "lat_dd")
LON_NAMES = ("longitude", "lon", "lng")
ID_NAMES = ("fine_cell_id", "cell_id", "id")


def _first(df: DataFrame, names: tuple[str, ...]) -> Column:
    """First non-NULL of the columns the table has."""
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(None).cast("string"))


def harmonize(df: DataFrame, lat=LAT_NAMES, lon=LON_NAMES, key=ID_NAMES) -> DataFrame:
    """Coordinates and key from alias columns; rows without valid coordinates drop out."""
    placed = df.withColumns({"_lat": to_number(_first(df, lat)), "_lon": to_number(_first(df, lon)), "_key": _first(df, key)})
    return placed.where(F.col("_lat").between(-90, 90) & F.col("_lon").between(-180, 180))


def severity_contains(feed: DataFrame, wanted: str = "ALL", cols: tuple[str, ...] = ("alert_severity", "severity")) -> DataFrame:
    """Substring match, so HIGH also keeps VERY HIGH."""
    if wanted == "ALL":
        return feed
    return feed.where(F.upper(F.coalesce(_first(feed, cols), F.lit(""))).contains(wanted))


def kpis(grid: DataFrame, alerts: DataFrame, tier: str = "risk_tier", status: str = "status") -> DataFrame:
    """Cells, HIGH and VERY HIGH cells, active alerts and the highest risk."""
    bucket = tier_bucket(F.col(tier))
    top = F.round(F.max(F.coalesce("risk_score", F.lit(0.0))), 3)
    cells = grid.agg(
        F.count(F.lit(1)).alias("total_cells"), F.count_if(bucket == "HIGH").alias("high_cells"),
        F.count_if(bucket == "VERY HIGH").alias("very_high_cells"), top.alias("max_risk"))
    active = alerts.agg(F.count_if(F.upper(F.col(status)).contains("ACTIVE")).alias("active_alerts"))
    return side_by_side(cells, active)


def tier_distribution(grid: DataFrame, tier: str = "risk_tier") -> DataFrame:
    bucket = tier_bucket(F.col(tier))
    rows = F.array(*[F.struct(F.lit(b).alias("name"), F.count_if(bucket == b).alias("count")) for b in BUCKETS])
    return grid.agg(rows.alias("_r")).select(F.inline("_r"))


def tier_priority(tier: Column) -> Column:
    bucket = tier_bucket(tier)
    return F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), bucket).cast("int")


def tier_priority_sort(grid: DataFrame, key: str, tier: str = "risk_tier") -> DataFrame:
    """Mildest tier first, so that severe cells are drawn on top."""
    return grid.withColumn("priority", tier_priority(F.col(tier))).orderBy("priority", key)


def horizon_stats(wide: DataFrame, horizon: str) -> DataFrame:
    """Highest and mean risk and severe counts over cells with a forecast."""
    risk, bucket = F.col(f"`risk_{horizon}`"), tier_bucket(F.col(f"`tier_{horizon}`"))
    known = wide.where(risk.isNotNull())
    return known.agg(
        F.round(F.max(risk), 3).alias("max"), F.round(F.avg(risk), 3).alias("avg"),
        F.count_if(bucket == "HIGH").alias("high_count"), F.count_if(bucket == "VERY HIGH").alias("very_high_count"))


def top_hotspots(forecast: DataFrame, n: int = 5) -> DataFrame:
    known = forecast.where(F.col("forecast_risk_score").isNotNull())
    return known.orderBy(F.desc("forecast_risk_score"), "station_id", "horizon_h").limit(n)


def risk_profile(df: DataFrame) -> DataFrame:
    """The four figures of one location under whichever names the table uses."""
    def shown(*names: str) -> Column:
        return F.coalesce(_first(df, names), F.lit("N/A"))

    return df.withColumns({
        "profile_susceptibility": shown("susceptibility_score", "susceptibility"),
        "profile_rainfall": shown("rainfall_trigger_index", "r_idx"),
        "profile_risk": shown("risk_score", "risk"),
        "profile_tier": shown("risk_tier", "risk_category"),
    })


def feed_stats(grid: DataFrame, tier: str = "risk_tier") -> DataFrame:
    """Counts by substring (High includes Very High) and the score range."""
    text = F.coalesce(F.col(tier), F.lit(""))
    score = F.coalesce("risk_score", F.lit(0.0))
    return grid.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(text.contains("High")).alias("high"),
        F.count_if(text.contains("Very")).alias("very_high"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))
