"""Multi-horizon forecast of stations and grid cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hazardspark import params
from hazardspark.functions.numeric import clip01, percent, rounded
from hazardspark.functions.risk import rain_index, risk_score
from hazardspark.functions.tiers import risk_tier
from hazardspark.operators.ordering import first_per_key

HORIZON_HOURS = {h.name: h.hours for h in params.HORIZONS}


def horizon_hours(horizon: Column) -> Column:
    """Lead time in hours, for ordering."""
    return F.regexp_extract(horizon, r"(\d+)", 1).try_cast("int")


def _projected(h: params.Horizon) -> tuple[Column, Column, Column]:
    """What the three windows will hold at one lead time.

    Antecedent rain ages out of each window in proportion to the hours passed;
    the second day's depth alone fills the 24 h window at +48h.
    """
    c, a24, a72, a7d = F.col(h.column), F.col("a24"), F.col("a72"), F.col("a7d")
    if h.hours <= 12:
        return (a24 * F.lit((24.0 - h.hours) / 24.0) + c,
                a72 * F.lit((72.0 - h.hours) / 72.0) + c,
                a7d + c)
    if h.hours == 24:
        return c, a72 * F.lit(48.0 / 72.0) + c, a7d * F.lit(6.0 / 7.0) + c
    if h.hours == 48:
        return c - F.col("c24"), a24 + c, a7d * F.lit(5.0 / 7.0) + c
    raise ValueError(f"no projection for {h.name}")


def project_windows(stations: DataFrame) -> DataFrame:
    """One row per station and horizon with the projected windows.

    Input columns ``a24, a72, a7d`` (antecedent) and ``c6, c12, c24, c48``
    (cumulative forecast); both sets are replaced by the projection.
    """
    used = {"a24", "a72", "a7d", *[h.column for h in params.HORIZONS]}
    rows = []
    for h in params.HORIZONS:
        p24, p72, p7d = _projected(h)
        rows.append(F.struct(
            F.lit(h.name).alias("forecast_horizon"), F.lit(h.hours).alias("horizon_h"),
            F.col(h.column).alias("period_mm"),
            p24.alias("p24"), p72.alias("p72"), p7d.alias("p7d"),
        ))
    keep = [c for c in stations.columns if c not in used]
    return stations.select(*keep, F.inline(F.array(*rows)))


def station_forecast(stations: DataFrame, mm_digits: int | None = 1,
                     score_digits: int | None = 4) -> DataFrame:
    """Long station forecast. A missing forecast falls back to ``s`` unchanged."""
    long = project_windows(stations)
    offline = F.col("period_mm").isNull()
    index = F.when(~offline, rain_index(F.col("p24"), F.col("p72"), F.col("p7d")))
    long = long.withColumn("_index", index)
    long = long.withColumn("_risk", F.when(offline, F.col("s")).otherwise(risk_score(F.col("s"), F.col("_index"))))
    keep = [c for c in stations.columns
            if c not in {"s", "a24", "a72", "a7d", *[h.column for h in params.HORIZONS]}]

    def depth(col: str) -> Column:
        return rounded(F.when(~offline, F.col(col)), mm_digits)

    return long.select(
        *keep, "forecast_horizon", "horizon_h",
        rounded(F.col("s"), score_digits).alias("susceptibility_score"),
        depth("period_mm").alias("forecast_rainfall_period_mm"),
        depth("p24").alias("projected_rolling_24h_mm"),
        depth("p72").alias("projected_rolling_72h_mm"),
        depth("p7d").alias("projected_rolling_7d_mm"),
        rounded(F.col("_index"), score_digits).alias("rainfall_trigger_index"),
        rounded(F.col("_risk"), score_digits).alias("forecast_risk_score"),
        risk_tier(F.col("_risk")).alias("risk_category"),
        F.when(offline, F.lit("static_baseline_only")).otherwise(F.lit("forecast_composite")).alias("risk_mode"),
        F.when(offline, F.lit("unavailable")).otherwise(F.lit("available")).alias("forecast_status"),
    )


def baseline_now(stations: DataFrame, digits: int | None = 4) -> DataFrame:
    """Present risk of stations from antecedent rain alone."""
    index = rain_index(F.col("a24"), F.col("a72"), F.col("a7d"))
    risk = risk_score(F.col("s"), F.col("_index"))
    return stations.withColumn("_index", index).withColumn("_risk", risk).select(
        "station_id",
        rounded(F.col("_index"), digits).alias("baseline_index"),
        rounded(F.col("_risk"), digits).alias("baseline_risk"),
        risk_tier(F.col("_risk")).alias("baseline_tier"),
    )


def scenario_forecast(grid: DataFrame, multipliers: dict[str, float] = params.SCENARIO,
                      s: str = "susceptibility_score", index: str = "rainfall_trigger_index",
                      keep: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """Grid forecast in long form: the trigger index scaled per horizon."""
    keep = ["cell_id"] if keep is None else keep
    steps = F.array(*[
        F.struct(F.lit(h).alias("forecast_horizon"), F.lit(HORIZON_HOURS[h]).alias("horizon_h"),
                 F.lit(m).alias("_m"))
        for h, m in multipliers.items()
    ])
    long = grid.select(*keep, F.col(s).alias("_s"), F.col(index).alias("_base"), F.inline(steps))
    long = long.withColumn("_index", clip01(F.col("_base") * F.col("_m")))
    long = long.withColumn("_risk", risk_score(F.col("_s"), F.col("_index")))
    return long.select(
        *keep, F.col("_s").alias("susceptibility_score"), "forecast_horizon", "horizon_h",
        rounded(F.col("_index"), digits).alias("ridx"),
        rounded(F.col("_risk"), digits).alias("risk"),
        risk_tier(F.col("_risk")).alias("tier"),
        F.col("_risk").alias("risk_raw"),
    )


def to_wide(long: DataFrame, keys: list[str]) -> DataFrame:
    """Long grid forecast -> ``ridx_/risk_/tier_`` per horizon."""
    names = [h.name for h in params.HORIZONS]
    picks = []
    for h in names:
        for c in ("ridx", "risk", "tier"):
            picks.append(F.max(F.when(F.col("forecast_horizon") == h, F.col(c))).alias(f"{c}_{h}"))
    return long.groupBy(*keys).agg(*picks)


def grid_forecast_long(wide: DataFrame, horizon: str | None = None) -> DataFrame:
    """Wide grid forecast -> long, for one horizon or all; no shuffle."""
    names = [h.name for h in params.HORIZONS if f"risk_{h.name}" in wide.columns]
    if horizon is not None:
        if horizon not in names:
            raise ValueError(f"horizon {horizon!r} not available, have {names}")
        names = [horizon]
    fixed = [c for c in wide.columns if not c.startswith(("ridx_", "risk_", "tier_"))]
    rows = F.array(*[
        F.struct(F.lit(h).alias("forecast_horizon"), F.col(f"`ridx_{h}`").alias("ridx"),
                 F.col(f"`risk_{h}`").alias("risk"), F.col(f"`tier_{h}`").alias("tier"))
        for h in names
    ])
    return wide.select(*fixed, F.inline(rows))


def horizon_summary(long: DataFrame, risk: str = "risk_raw", tier: str = "tier",
                    digits: int | None = 4) -> DataFrame:
    """Mean, max, tier counts and share of High or Very High per horizon."""
    tiers = [F.count_if(F.col(tier) == t).alias(t.lower().replace(" ", "_")) for t in params.TIER_ORDER]
    severe = F.count_if(F.col(tier).isin("High", "Very High"))
    return long.groupBy("forecast_horizon").agg(
        F.count(F.lit(1)).alias("cells"),
        rounded(F.avg(risk), digits).alias("mean_risk"),
        rounded(F.max(risk), digits).alias("max_risk"),
        *tiers,
        rounded(percent(severe, F.count(F.lit(1))), 2).alias("pct_high_or_very_high"),
    )


def peak_horizon(forecast: DataFrame) -> DataFrame:
    """Highest stored risk per station, earliest horizon on a tie."""
    peak = first_per_key(forecast, ["station_id"], [F.desc_nulls_last("forecast_risk_score"), F.asc("horizon_h")])
    online = F.col("forecast_status") == "available"
    return peak.select(
        "station_id", "susceptibility_score",
        F.col("forecast_risk_score").alias("peak_forecast_risk"),
        F.when(online, F.col("forecast_horizon")).otherwise(F.lit("N/A (Offline)")).alias("peak_horizon"),
        F.when(online, F.col("risk_category")).otherwise(risk_tier(F.col("susceptibility_score"))).alias("peak_category"),
        F.when(online, F.lit("available")).otherwise(F.lit("offline_fallback")).alias("status"),
    )


def tier_migration(baseline: DataFrame, long: DataFrame, base_tier: str = "risk_category") -> DataFrame:
    """Share of cells per tier for the baseline and each horizon, zero-filled."""
    steps = baseline.select(F.lit("Baseline").alias("step"), F.col(base_tier).alias("tier"))
    steps = steps.unionByName(long.select(F.col("forecast_horizon").alias("step"), "tier"))
    total = F.count(F.lit(1))
    rows = F.array(*[
        F.struct(F.lit(t).alias("tier"), F.count_if(F.col("tier") == t).alias("cells"),
                 percent(F.count_if(F.col("tier") == t), total).alias("pct"))
        for t in params.TIER_ORDER
    ])
    return steps.groupBy("step").agg(rows.alias("_rows")).select("step", F.inline("_rows"))


def fallback_check(forecast: DataFrame) -> DataFrame:
    """Offline rows must carry exactly the static score and no rainfall."""
    off = forecast.where(F.col("forecast_status") == "unavailable")
    same = F.col("forecast_risk_score") == F.col("susceptibility_score")
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in (
        "forecast_rainfall_period_mm", "projected_rolling_24h_mm", "projected_rolling_72h_mm",
        "projected_rolling_7d_mm", "rainfall_trigger_index")])
    return off.agg(
        F.count(F.lit(1)).alias("offline_rows"),
        F.coalesce(F.bool_and(same), F.lit(True)).alias("risk_equals_s"),
        F.coalesce(F.bool_and(empty), F.lit(True)).alias("nothing_invented"),
    )
