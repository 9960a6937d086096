"""Alert feeds and their dispatch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardspark import params
from hazardspark.functions.numeric import nan_to_null
from hazardspark.functions.tiers import alert_severity
from hazardspark.operators.forecast import HORIZON_HOURS
from hazardspark.operators.neighbours import nearest_label
from hazardspark.operators.ordering import first_per_key, with_position
from hazardspark.session import materialize

KEY = ["location_id", "forecast_horizon", "alert_severity"]

# fixed values: texts of the alert feed and message
DISCLAIMER = "SIMULATED / PROTOTYPE ALERT"
RULE_LINE = "━" * 29
PILOT_DISTRICT = "Sikkim"
ACTION_VERY_HIGH = ("Urgent: Pre-position clearance machinery, alert NDRF/SDRF units, "
                    "restrict traffic on vulnerable corridors.")
ACTION_HIGH = ("Advisory: Inspect road drainage culverts, alert local line-department patrols, "
               "monitor rainfall telemetry.")
NOTICE = ("In this prototype, alerts are automatically dispatched to a simulated DDMA test channel "
          "and displayed on the live GIS dashboard. In a production deployment, the same alert API "
          "can be connected to authorized state disaster-management communication channels.")

FEED_COLUMNS = (
    "alert_id alert_type location station_id district latitude longitude forecast_horizon risk_score "
    "risk_tier alert_severity susceptibility rainfall_trigger_index forecast_rainfall_mm timestamp status "
    "risk_mode disclaimer"
).split()


def with_severity(df: DataFrame, risk: str) -> DataFrame:
    """Rows at or above the alert floor with their severity."""
    return df.withColumn("alert_severity", alert_severity(F.col(risk))).where(F.col("alert_severity").isNotNull())


def dedup_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return first_per_key(df, keys, order)


def rejected_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows kept by the first-per-key rule and rows it rejects."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("rejected"))


def _tail(at: Column, mode: Column) -> list[Column]:
    return [at.alias("timestamp"), F.lit("ACTIVE").alias("status"), mode.alias("risk_mode"),
            F.lit(DISCLAIMER).alias("disclaimer")]


def hotspot_alerts(forecast: DataFrame, at: Column) -> DataFrame:
    """Alerts of monitored stations, without ids. Offline stations keep NULL rain.

    ``forecast`` is the stored station forecast with ``latitude, longitude``.
    """
    alerts = with_severity(forecast, "forecast_risk_score")
    alerts = dedup_first(alerts, ["station_name", "forecast_horizon", "alert_severity"], ["station_id", "horizon_h"])
    return alerts.select(
        F.lit("HOTSPOT_CORRIDOR").alias("alert_type"), F.col("station_name").alias("location"),
        F.col("station_id").cast("string").alias("station_id"), "district",
        F.bround("latitude", 4).alias("latitude"), F.bround("longitude", 4).alias("longitude"), "forecast_horizon",
        F.col("forecast_risk_score").alias("risk_score"), F.col("risk_category").alias("risk_tier"), "alert_severity",
        F.col("susceptibility_score").alias("susceptibility"), "rainfall_trigger_index",
        F.bround("forecast_rainfall_period_mm", 1).alias("forecast_rainfall_mm"),
        *_tail(at, F.col("risk_mode")), F.col("station_id").alias("_order"), "horizon_h")


def grid_alerts(forecast: DataFrame, grid_risk: DataFrame, inventory: DataFrame, at: Column,
                ref_id: str = "sl_no", multipliers: dict[str, float] = params.SCENARIO) -> DataFrame:
    """Alerts of grid cells, without ids.

    ``forecast`` is the long grid forecast with stored 4-digit risk; the
    threshold applies to that stored value. ``grid_risk`` brings the rainfall by
    cell key; the district is that of the nearest inventory point, looked up
    only for cells that alert.
    """
    alerts = dedup_first(with_severity(forecast, "risk"), ["cell_id", "forecast_horizon", "alert_severity"], ["horizon_h"])
    rain = grid_risk.select("cell_id", "rainfall_24h")
    # stored once: the neighbour search and the join back both read the alerts
    alerts = materialize(alerts.join(rain, "cell_id", "left"), "alerts")
    alerts = nearest_label(alerts, inventory, "district", ref_id)
    scale = F.create_map(*[F.lit(v) for kv in multipliers.items() for v in kv])
    place = F.format_string("Cell %s (%.3fN, %.3fE)", F.col("cell_id").cast("string"), F.col("latitude"), F.col("longitude"))
    return alerts.select(
        F.lit("REGIONAL_GRID_CELL").alias("alert_type"), place.alias("location"),
        F.col("cell_id").cast("string").alias("station_id"), "district",
        F.bround("latitude", 4).alias("latitude"), F.bround("longitude", 4).alias("longitude"), "forecast_horizon",
        F.col("risk").alias("risk_score"), F.col("tier").alias("risk_tier"), "alert_severity",
        F.col("susceptibility_score").alias("susceptibility"), F.col("ridx").alias("rainfall_trigger_index"),
        F.bround(F.col("rainfall_24h") * F.try_element_at(scale, F.col("forecast_horizon")), 1).alias("forecast_rainfall_mm"),
        *_tail(at, F.lit("forecast_composite")), F.col("cell_id").alias("_order"), "horizon_h")


def alert_feed(hotspots: DataFrame, grid: DataFrame) -> DataFrame:
    """Hotspot alerts then grid alerts under one running number.

    Hotspots are numbered by station and horizon, grid cells by horizon and
    cell, continuing where the hotspots end.
    """
    hot = with_position(hotspots, ["_order", "horizon_h"], "_no", start=1)
    cells = with_position(grid, ["horizon_h", "_order"], "_no", start=1)
    cells = cells.withColumn("_no", F.col("_no") + hot.agg(F.count(F.lit(1))).scalar())
    hot = hot.withColumn("alert_id", F.format_string("ALT-HOTSPOT-%04d", "_no"))
    cells = cells.withColumn("alert_id", F.format_string("ALT-GRID-%05d", "_no"))
    return hot.select(*FEED_COLUMNS, F.col("_no").alias("feed_order")).unionByName(
        cells.select(*FEED_COLUMNS, F.col("_no").alias("feed_order")))


def alert_candidates(forecast: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows of both forecasts at or above the alert floor, before repeats are dropped.

    ``station_key`` is what :func:`hotspot_alerts` and :func:`grid_alerts` tell
    stations and cells by.
    """
    hot = with_severity(forecast, "forecast_risk_score").select(
        F.lit("HOTSPOT_CORRIDOR").alias("alert_type"), F.col("station_name").alias("station_key"), "forecast_horizon",
        "alert_severity")
    cells = with_severity(grid, "risk").select(
        F.lit("REGIONAL_GRID_CELL").alias("alert_type"), F.col("cell_id").cast("string").alias("station_key"),
        "forecast_horizon", "alert_severity")
    return hot.unionByName(cells)


def alert_summary(candidates: DataFrame) -> DataFrame:
    """Alerts and rejected repeats by type and severity with subtotals (NULL = all).

    Counted on the candidates: no alert needs its number, place or district for it.
    """
    keys = ["alert_type", "alert_severity", "station_key", "forecast_horizon"]
    groups = candidates.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_again"))
    return groups.rollup("alert_type", "alert_severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("_again").alias("rejected"))


def hotspot_breakdown(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("alert_type") == "HOTSPOT_CORRIDOR").select(
        "alert_id", "station_id", "location", "district", "forecast_horizon", "risk_score", "alert_severity",
        "forecast_rainfall_mm")


def peak_alert(feed: DataFrame, station_id: str) -> DataFrame:
    return feed.where(F.col("station_id") == station_id).orderBy(F.desc("risk_score"), "feed_order").limit(1)


def render_messages(feed: DataFrame, district: str = PILOT_DISTRICT) -> DataFrame:
    """Message text per alert; ``district`` stands where an alert names none."""
    severity = F.upper(F.coalesce("alert_severity", F.lit("HIGH")))
    urgent = severity == "VERY HIGH"
    index = F.coalesce(F.format_string("%.4f", "rainfall_trigger_index"), F.lit("N/A (Static Fallback)"))
    index = F.when(F.col("rainfall_trigger_index").isNull(), F.lit("N/A (Static Fallback)")).otherwise(index)
    rain = F.when(F.col("forecast_rainfall_mm").isNull(), F.lit("Unavailable (Offline Node)")).otherwise(
        F.format_string("%.1f mm", "forecast_rainfall_mm"))
    lines = [
        F.lit("🚨 *[SIMULATED / PROTOTYPE ALERT]* 🚨"),
        F.lit(RULE_LINE),
        F.concat(F.when(urgent, F.lit("🔴")).otherwise(F.lit("🟠")), F.lit(" *SEVERITY:* "), severity, F.lit(" WARNING")),
        F.concat(F.lit("📍 *LOCATION:* "), F.coalesce("location", F.lit("Unknown Corridor"))),
        F.concat(F.lit("🏛 *DISTRICT:* "), F.coalesce("district", F.lit(district))),
        F.concat(F.lit("⏱ *FORECAST HORIZON:* "), F.coalesce("forecast_horizon", F.lit("+24h")), F.lit(" Outlook")),
        F.format_string("📈 *FORECAST RISK SCORE:* %.4f", F.coalesce("risk_score", F.lit(0.0))),
        F.format_string("🏔 *STATIC SUSCEPTIBILITY (S):* %.4f", F.coalesce("susceptibility", F.lit(0.0))),
        F.concat(F.lit("🌧 *RAINFALL TRIGGER (R_idx):* "), index),
        F.concat(F.lit("💧 *FORECAST PRECIPITATION:* "), rain),
        F.concat(F.lit("🕒 *TIMESTAMP (UTC):* "), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.lit(RULE_LINE),
        F.lit("⚠️ *RECOMMENDED ACTION:*"),
        F.when(urgent, F.lit(ACTION_VERY_HIGH)).otherwise(F.lit(ACTION_HIGH)),
        F.lit(""),
        F.lit("ℹ️ *SYSTEM NOTICE:*"),
        F.lit(f"_{NOTICE}_"),
        F.lit(RULE_LINE),
    ]
    return feed.withColumn("message", F.concat_ws("\n", *lines))


def resolve_risk(df: DataFrame, names: tuple[str, ...] = ("risk_score", "risk", "forecast_risk_score")) -> DataFrame:
    """First given risk value; a text that is no number counts as 0."""
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    raw = F.coalesce(*have, F.lit("0"))
    return df.withColumn("risk_score", F.coalesce(nan_to_null(raw.try_cast("double")), F.lit(0.0)))


def eligible(feed: DataFrame) -> DataFrame:
    """Monitored corridors (if the feed tells types) at or above the alert floor."""
    if "alert_type" in feed.columns:
        feed = feed.where(F.col("alert_type") == "HOTSPOT_CORRIDOR")
    return feed.where(F.col("risk_score") >= params.ALERT_FLOOR)


def with_key(feed: DataFrame, station: str = "station_id") -> DataFrame:
    """Ledger key columns: station, horizon and upper-case severity from the risk."""
    return feed.withColumns({
        "location_id": F.col(station).cast("string"), "alert_severity": F.upper(alert_severity(F.col("risk_score")))})


def plan_dispatch(feed: DataFrame, ledger: DataFrame, order: list[str], cap: int = 2,
                  outcome: str | None = None) -> DataFrame:
    """Status of every keyed alert of one cycle, in feed order.

    Without ``outcome`` the first alert of each key not in the ledger is
    PLANNED, at most ``cap`` of them. With an ``outcome`` column (replay, known
    results) the cap counts SENT rows only: failed and disabled rows do not use
    it up, and a key is retried until one of its rows is SENT. Rows after the
    cap was reached are DEFERRED, repeats SKIPPED_DUPLICATE.
    """
    done = F.lit("PLANNED") if outcome is None else F.col(outcome)
    win = "PLANNED" if outcome is None else "SENT"
    rows = feed.withColumns({"_pos": F.struct(*order), "_result": done})
    known = ledger.select(*KEY).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, KEY, "left")
    fresh = rows.where(F.col("_known").isNull() & (F.col("_result") == win))
    wins = first_per_key(fresh, KEY, ["_pos"]).select(*KEY, F.col("_pos").alias("_won"))
    last = wins.orderBy("_won").limit(cap).agg(F.max("_won").alias("cut"), F.count(F.lit(1)).alias("n"))
    cut = last.select(F.when(F.col("n") >= cap, F.col("cut"))).scalar()
    rows = rows.join(wins, KEY, "left").withColumn("_cut", cut)
    status = (
        F.when(F.col("_pos") > F.col("_cut"), F.lit("DEFERRED"))
        .when(F.col("_known").isNotNull() | (F.col("_pos") > F.col("_won")), F.lit("SKIPPED_DUPLICATE"))
        .otherwise(F.col("_result"))
    )
    return rows.withColumn("status", status).drop("_pos", "_result", "_known", "_won", "_cut")


def apply_outcomes(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Remember keys of SENT rows only; applying a batch twice changes nothing."""
    return ledger.select(*KEY).unionByName(outcomes.where(F.col("status") == "SENT").select(*KEY)).distinct()


def dispatch_report(outcomes: DataFrame) -> DataFrame:
    """Counts by status and the overall result."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    out = outcomes.agg(
        F.count(F.lit(1)).alias("total"), n("SENT").alias("sent"), n("FAILED").alias("failed"),
        n("DISABLED").alias("disabled"), n("SKIPPED_DUPLICATE").alias("skipped_duplicate"))
    overall = (F.when(F.col("sent") > 0, F.lit("COMPLETE")).when(F.col("disabled") > 0, F.lit("BLOCKED"))
               .otherwise(F.lit("FAILED")))
    return out.withColumn("overall_status", overall)


def one_per_severity(feed: DataFrame, order: list) -> DataFrame:
    return first_per_key(feed, ["alert_severity"], order)


def ledger_reset(ledger: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Ledger without the given keys, or empty."""
    if keys is None:
        return ledger.limit(0)
    return ledger.join(keys.select(*KEY), KEY, "left_anti")


HORIZONS = tuple(HORIZON_HOURS)
