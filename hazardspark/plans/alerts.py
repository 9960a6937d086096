"""Alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import alerts, forecast, risk
from hazardspark.plans import sqltext as q
from hazardspark.plans.forecast import LONG, STATION
from hazardspark.plans.registry import query
from hazardspark.plans.spatial import DD

def issued():
    """Issue time of the fixture feed."""
    return F.to_timestamp(F.lit("2024-02-01 06:00:00"))


E4 = q.even

SEV = f", sev AS (SELECT * FROM (SELECT *, {q.severity('risk_score')} AS alert_severity FROM fx_alert_candidates) x WHERE alert_severity IS NOT NULL)"
FIRST = ", firsts AS (SELECT * FROM sev QUALIFY row_number() OVER (PARTITION BY station_id, forecast_horizon, alert_severity ORDER BY ts, event_id) = 1)"


def severe(t):
    return alerts.with_severity(t.fx_alert_candidates, "risk_score")


CAND_KEYS = ["station_id", "forecast_horizon", "alert_severity"]


@query("j1_severity", "fx_alert_candidates", SEV + "SELECT event_id, risk_score, alert_severity FROM sev")
def j1(t):
    return severe(t).select("event_id", "risk_score", "alert_severity")


@query("j2_dedup_first", "fx_alert_candidates", SEV + FIRST + "SELECT event_id, station_id, forecast_horizon, alert_severity FROM firsts")
def j2(t):
    return alerts.dedup_first(severe(t), CAND_KEYS, ["ts", "event_id"]).select("event_id", *CAND_KEYS)


@query("j2_rejected_count", "fx_alert_candidates", SEV + FIRST + "SELECT (SELECT count(*) FROM firsts) AS kept, (SELECT count(*) FROM sev) - (SELECT count(*) FROM firsts) AS rejected")
def j2_rejected(t):
    return alerts.rejected_count(severe(t), CAND_KEYS)


# stations on the map: the fixture has no coordinates, so they follow the id
HOT = STATION + f"""
, place AS (SELECT s_suppkey AS station_id, CAST(27000000 + (s_suppkey * 7919) % 900 * 1000 AS DOUBLE) / 1e6 AS latitude,
    CAST(88000000 + (s_suppkey * 10459) % 900 * 1000 AS DOUBLE) / 1e6 AS longitude FROM supplier)
, st4 AS (SELECT x.*, {E4('rk', 4)} AS r4, {E4('ri', 4)} AS i4, {E4('c', 1)} AS mm, {q.tier('rk')} AS tier FROM station x)
, hot AS (SELECT 'HOTSPOT_CORRIDOR' AS alert_type, station_name AS location, CAST(st4.station_id AS VARCHAR) AS station_id, district, latitude, longitude,
    forecast_horizon, r4 AS risk_score, tier AS risk_tier, {q.severity('r4')} AS alert_severity, s AS susceptibility, i4 AS rainfall_trigger_index,
    mm AS forecast_rainfall_mm, CASE WHEN c IS NULL THEN 'static_baseline_only' ELSE 'forecast_composite' END AS risk_mode,
    row_number() OVER (ORDER BY st4.station_id, horizon_h) AS no
  FROM st4 JOIN place ON place.station_id = st4.station_id WHERE r4 >= 0.55::DOUBLE)
"""
REGION = f"""
, cell AS (SELECT cell_id, CAST(27050000 + (cell_id * 7919) % 800 * 1000 AS DOUBLE) / 1e6 AS latitude, CAST(88050000 + (cell_id * 10459) % 797 * 1000 AS DOUBLE) / 1e6 AS longitude FROM fx_scored)
, g4 AS (SELECT l.cell_id, l.s, l.h, l.hh, {E4('pi', 4)} AS i4, {E4('rk', 4)} AS r4, {q.tier('rk')} AS tier FROM long l)
, hit AS (SELECT g4.*, latitude, longitude FROM g4 JOIN cell ON cell.cell_id = g4.cell_id WHERE r4 >= 0.55::DOUBLE)
, spot AS (SELECT DISTINCT latitude, longitude FROM hit)
, named AS (SELECT a.latitude, a.longitude, b.district FROM spot a JOIN fx_points b ON b.label = 1
    QUALIFY row_number() OVER (PARTITION BY a.latitude, a.longitude ORDER BY {DD}, b.sl_no) = 1)
, grd AS (SELECT 'REGIONAL_GRID_CELL' AS alert_type, printf('Cell %s (%.3fN, %.3fE)', CAST(hit.cell_id AS VARCHAR), hit.latitude, hit.longitude) AS location,
    CAST(hit.cell_id AS VARCHAR) AS station_id, n.district, hit.latitude, hit.longitude, h AS forecast_horizon, r4 AS risk_score, tier AS risk_tier,
    {q.severity('r4')} AS alert_severity, hit.s AS susceptibility, i4 AS rainfall_trigger_index,
    {E4(E4('f.r24', 2) + " * (CASE h WHEN '+6h' THEN 1.15::DOUBLE WHEN '+12h' THEN 1.45::DOUBLE WHEN '+24h' THEN 1.85::DOUBLE ELSE 1.6::DOUBLE END)", 1)} AS forecast_rainfall_mm,
    'forecast_composite' AS risk_mode, row_number() OVER (ORDER BY hh, hit.cell_id) AS no
  FROM hit JOIN named n ON n.latitude = hit.latitude AND n.longitude = hit.longitude JOIN fx_scored f ON f.cell_id = hit.cell_id)
"""
COLS = ("alert_type, location, station_id, district, latitude, longitude, forecast_horizon, risk_score, risk_tier, alert_severity, "
        "susceptibility, rainfall_trigger_index, forecast_rainfall_mm, risk_mode")
SHOWN = COLS.split(", ")
FEED = HOT + LONG + REGION + f"""
, feed AS (SELECT printf('ALT-HOTSPOT-%04d', no) AS alert_id, {COLS}, no AS feed_order FROM hot
  UNION ALL SELECT printf('ALT-GRID-%05d', no + (SELECT count(*) FROM hot)), {COLS}, no + (SELECT count(*) FROM hot) FROM grd)
"""


def station_reports(t):
    key = F.col("s_suppkey")
    place = t.supplier.select(
        key.alias("station_id"), ((F.lit(27000000) + key * 7919 % 900 * 1000).cast("double") / 1e6).alias("latitude"),
        ((F.lit(88000000) + key * 10459 % 900 * 1000).cast("double") / 1e6).alias("longitude"))
    return forecast.station_forecast(t.fx_stations).join(place, "station_id")


def hotspots(t):
    return alerts.hotspot_alerts(station_reports(t), issued())


def regional_forecast(t):
    """The long forecast of the cells, and the cells."""
    key = F.col("cell_id")
    cells = risk.score_cells(t.fx_scored, score_digits=None).withColumns({
        "latitude": (F.lit(27050000) + key * 7919 % 800 * 1000).cast("double") / 1e6,
        "longitude": (F.lit(88050000) + key * 10459 % 797 * 1000).cast("double") / 1e6,
    })
    return forecast.scenario_forecast(cells, keep=["cell_id", "latitude", "longitude"]), cells


def regional(t):
    long, cells = regional_forecast(t)
    return alerts.grid_alerts(long, cells, t.fx_points.where(F.col("label") == 1), issued())


def feed(t):
    return alerts.alert_feed(hotspots(t), regional(t))


@query("j3_alert_ids", "fx_stations fx_scored fx_points", FEED + "SELECT alert_id, station_id, forecast_horizon, alert_severity FROM feed")
def j3(t):
    return feed(t).select("alert_id", "station_id", "forecast_horizon", "alert_severity")


@query("j4_hotspot_alerts", "fx_stations", HOT + f"SELECT {COLS} FROM hot")
def j4(t):
    return hotspots(t).select(*SHOWN)


@query("j5_grid_alerts", "fx_scored fx_points", LONG + REGION + f"SELECT {COLS} FROM grd")
def j5(t):
    return regional(t).select(*SHOWN)


@query("j6_alert_feed", "fx_stations fx_scored fx_points", FEED + f"""
SELECT alert_id, {COLS}, feed_order, TIMESTAMP '2024-02-01 06:00:00' AS timestamp, 'ACTIVE' AS status, '{alerts.DISCLAIMER}' AS disclaimer FROM feed""")
def j6(t):
    return feed(t)


@query("j7_alert_summary", "fx_stations fx_scored fx_points", FEED + """
SELECT alert_type, alert_severity, count(DISTINCT (alert_type, location, forecast_horizon, alert_severity)) AS alerts,
  count(*) - count(DISTINCT (alert_type, location, forecast_horizon, alert_severity)) AS rejected
FROM (SELECT * FROM feed UNION ALL SELECT * FROM feed WHERE alert_type = 'HOTSPOT_CORRIDOR' AND CAST(station_id AS BIGINT) % 3 = 0) x
GROUP BY ROLLUP (alert_type, alert_severity)""")
def j7(t):
    """Every third station reports twice."""
    reports = station_reports(t)
    reports = reports.unionByName(reports.where(F.col("station_id") % 3 == 0))
    return alerts.alert_summary(alerts.alert_candidates(reports, regional_forecast(t)[0]))


@query("j7_hotspot_breakdown", "fx_stations fx_scored fx_points", FEED + """
SELECT alert_id, station_id, location, district, forecast_horizon, risk_score, alert_severity, forecast_rainfall_mm FROM feed WHERE alert_type = 'HOTSPOT_CORRIDOR'""")
def j7_breakdown(t):
    return alerts.hotspot_breakdown(feed(t))


@query("j8_peak_alert", "fx_stations", HOT + """
SELECT station_id, forecast_horizon, risk_score FROM hot WHERE station_id = '1' ORDER BY risk_score DESC, no LIMIT 1""")
def j8(t):
    numbered = hotspots(t).withColumn("feed_order", F.col("horizon_h"))
    return alerts.peak_alert(numbered, "1").select("station_id", "forecast_horizon", "risk_score")


LINES = [
    "'🚨 *[SIMULATED / PROTOTYPE ALERT]* 🚨'", f"'{alerts.RULE_LINE}'",
    "CASE alert_severity WHEN 'VERY HIGH' THEN '🔴' ELSE '🟠' END || ' *SEVERITY:* ' || alert_severity || ' WARNING'",
    "'📍 *LOCATION:* ' || location", "'🏛 *DISTRICT:* ' || district", "'⏱ *FORECAST HORIZON:* ' || forecast_horizon || ' Outlook'",
    "printf('📈 *FORECAST RISK SCORE:* %.4f', risk_score)", "printf('🏔 *STATIC SUSCEPTIBILITY (S):* %.4f', susceptibility)",
    "'🌧 *RAINFALL TRIGGER (R_idx):* ' || coalesce(printf('%.4f', rainfall_trigger_index), 'N/A (Static Fallback)')",
    "'💧 *FORECAST PRECIPITATION:* ' || coalesce(printf('%.1f mm', forecast_rainfall_mm), 'Unavailable (Offline Node)')",
    "'🕒 *TIMESTAMP (UTC):* 2024-02-01T06:00:00Z'", f"'{alerts.RULE_LINE}'", "'⚠️ *RECOMMENDED ACTION:*'",
    f"CASE alert_severity WHEN 'VERY HIGH' THEN '{alerts.ACTION_VERY_HIGH}' ELSE '{alerts.ACTION_HIGH}' END",
    "''", "'ℹ️ *SYSTEM NOTICE:*'", f"'_{alerts.NOTICE}_'", f"'{alerts.RULE_LINE}'",
]


@query("j9_render_messages", "fx_stations", HOT + "SELECT station_id, forecast_horizon, " + " || chr(10) || ".join(LINES) + " AS message FROM hot")
def j9(t):
    return alerts.render_messages(hotspots(t)).select("station_id", "forecast_horizon", "message")


MIXED = """
, mixed AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(risk_score AS VARCHAR) END AS risk_score,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE risk_score / 2 END AS risk, CASE WHEN event_id % 30 = 0 THEN NULL ELSE risk_score / 4 END AS forecast_risk_score
  FROM fx_alert_candidates)
"""


@query("j10_resolve_risk", "fx_alert_candidates", MIXED + """
SELECT event_id, coalesce(TRY_CAST(coalesce(risk_score, CAST(risk AS VARCHAR), CAST(forecast_risk_score AS VARCHAR), '0') AS DOUBLE), 0e0) AS risk_score FROM mixed""")
def j10(t):
    e, r = F.col("event_id"), F.col("risk_score")
    raw = t.fx_alert_candidates.select(
        "event_id", F.when(e % 5 == 0, F.lit(None)).when(e % 7 == 0, F.lit("n/a")).otherwise(r.cast("string")).alias("risk_score"),
        F.when(e % 10 == 0, F.lit(None)).otherwise(r / 2).alias("risk"),
        F.when(e % 30 == 0, F.lit(None)).otherwise(r / 4).alias("forecast_risk_score"))
    return alerts.resolve_risk(raw).select("event_id", "risk_score")


def typed(t):
    """Alert candidates with a type: clicks come from grid cells."""
    grid = F.col("forecast_horizon") == "+12h"
    return t.fx_alert_candidates.withColumn("alert_type", F.when(grid, "REGIONAL_GRID_CELL").otherwise("HOTSPOT_CORRIDOR"))


@query("j11_eligible", "fx_alert_candidates", "SELECT event_id FROM fx_alert_candidates WHERE forecast_horizon <> '+12h' AND risk_score >= 0.55::DOUBLE")
def j11(t):
    return alerts.eligible(typed(t)).select("event_id")


# ledger: keys of the first day; outcomes: every third alert fails
KEYED = f"""
, keyed AS (SELECT event_id, ts, CAST(station_id AS VARCHAR) AS location_id, forecast_horizon, {q.severity('risk_score')} AS alert_severity,
    CASE WHEN event_id % 3 = 0 THEN 'FAILED' ELSE 'SENT' END AS outcome FROM fx_alert_candidates WHERE risk_score >= 0.55::DOUBLE)
, ledger AS (SELECT DISTINCT location_id, forecast_horizon, alert_severity FROM keyed WHERE ts < TIMESTAMP '2024-01-04')
, open AS (SELECT k.*, EXISTS (SELECT 1 FROM ledger l WHERE l.location_id = k.location_id AND l.forecast_horizon = k.forecast_horizon AND l.alert_severity = k.alert_severity) AS known FROM keyed k)
"""
WON = """
, won AS (SELECT location_id, forecast_horizon, alert_severity, min((ts, event_id)) AS w FROM open WHERE NOT known {only} GROUP BY ALL)
, cut AS (SELECT CASE WHEN count(*) >= {cap} THEN max(w) END AS c FROM (SELECT w FROM won ORDER BY w LIMIT {cap}))
, planned AS (SELECT o.*, CASE WHEN (SELECT c FROM cut) IS NOT NULL AND (o.ts, o.event_id) > (SELECT c FROM cut) THEN 'DEFERRED'
    WHEN known OR (won.w IS NOT NULL AND (o.ts, o.event_id) > won.w) THEN 'SKIPPED_DUPLICATE' ELSE {result} END AS status
  FROM open o LEFT JOIN won ON won.location_id = o.location_id AND won.forecast_horizon = o.forecast_horizon AND won.alert_severity = o.alert_severity)
"""
ATTEMPTS = KEYED + WON.format(only="", cap=2, result="'PLANNED'")
REPLAY = KEYED + WON.format(only="AND outcome = 'SENT'", cap=5, result="outcome")


def keyed(t):
    rows = alerts.with_key(alerts.eligible(t.fx_alert_candidates))
    return rows.withColumn("outcome", F.when(F.col("event_id") % 3 == 0, "FAILED").otherwise("SENT"))


def ledger(t):
    return keyed(t).where(F.col("ts") < "2024-01-04").select(*alerts.KEY).distinct()


def replay(t):
    return alerts.plan_dispatch(keyed(t), ledger(t), ["ts", "event_id"], cap=5, outcome="outcome")


@query("j12_plan_dispatch", "fx_alert_candidates", ATTEMPTS + "SELECT event_id, status FROM planned")
def j12(t):
    return alerts.plan_dispatch(keyed(t), ledger(t), ["ts", "event_id"], cap=2).select("event_id", "status")


@query("j12_plan_dispatch_replay", "fx_alert_candidates", REPLAY + "SELECT event_id, status FROM planned")
def j12_replay(t):
    return replay(t).select("event_id", "status")


@query("j13_apply_outcomes", "fx_alert_candidates", REPLAY + """
SELECT * FROM ledger UNION SELECT location_id, forecast_horizon, alert_severity FROM planned WHERE status = 'SENT'""")
def j13(t):
    return alerts.apply_outcomes(ledger(t), replay(t))


@query("j14_dispatch_report", "fx_alert_candidates", REPLAY + """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'SENT') AS sent, count(*) FILTER (WHERE status = 'FAILED') AS failed,
  count(*) FILTER (WHERE status = 'DISABLED') AS disabled, count(*) FILTER (WHERE status = 'SKIPPED_DUPLICATE') AS skipped_duplicate,
  CASE WHEN count(*) FILTER (WHERE status = 'SENT') > 0 THEN 'COMPLETE' ELSE 'FAILED' END AS overall_status FROM planned WHERE status <> 'DEFERRED'""")
def j14(t):
    return alerts.dispatch_report(replay(t).where(F.col("status") != "DEFERRED"))


@query("j15_one_per_severity", "fx_alert_candidates", SEV + """
SELECT event_id, alert_severity FROM sev QUALIFY row_number() OVER (PARTITION BY alert_severity ORDER BY ts, event_id) = 1""")
def j15(t):
    return alerts.one_per_severity(severe(t), ["ts", "event_id"]).select("event_id", "alert_severity")


@query("j16_ledger_reset", "fx_alert_candidates", KEYED + """
SELECT DISTINCT location_id, forecast_horizon, alert_severity FROM open WHERE NOT known""")
def j16(t):
    full = keyed(t).select(*alerts.KEY).distinct()
    return alerts.ledger_reset(full, ledger(t))
