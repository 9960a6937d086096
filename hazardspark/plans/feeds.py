"""Feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.functions.tiers import susceptibility_tier
from hazardspark.operators import feeds, forecast, risk
from hazardspark.plans import alerts as alert_plans
from hazardspark.plans import attribution
from hazardspark.plans import sqltext as q
from hazardspark.plans.forecast import LONG, RISKED, STATION, grid_long
from hazardspark.plans.registry import query
from hazardspark.session import new_path

COARSE = f"""
, {RISKED}, coarse AS (SELECT cell_id, s, {q.tier('s', (0.70, 0.50, 0.35), 'NULL')} AS risk_tier, {q.tier('rk')} AS risk_category, {q.even('rk', 4)} AS risk_score FROM risked)
"""


def coarse(t):
    scored = risk.score_cells(t.fx_scored)
    return scored.select("cell_id", "s", susceptibility_tier(F.col("s")).alias("risk_tier"), "risk_category", "risk_score")


NTH = "(SELECT *, row_number() OVER (ORDER BY cell_id) - 1 AS pos FROM coarse)"


@query("m1_q_coarse", "fx_scored", COARSE + f"""
SELECT cell_id, risk_tier, risk_score FROM (SELECT * FROM {NTH} x WHERE pos % 10 = 0 ORDER BY cell_id LIMIT 400) y WHERE lower(risk_tier) = 'high'""")
def m1(t):
    return feeds.q_coarse(coarse(t), ["cell_id"], sample_step=10, limit=400, tier="HIGH").select("cell_id", "risk_tier", "risk_score")


@query("m1_q_coarse_filter_first", "fx_scored", COARSE + """
SELECT cell_id, risk_category FROM (SELECT *, row_number() OVER (ORDER BY cell_id) - 1 AS pos FROM coarse WHERE risk_category = 'Very High') x WHERE pos % 3 = 0""")
def m1_first(t):
    return feeds.q_coarse(coarse(t), ["cell_id"], sample_step=3, tier="very high", column="risk_category", filter_first=True).select("cell_id", "risk_category")


@query("m1_q_coarse_district", "fx_scored", COARSE + "SELECT cell_id FROM coarse WHERE FALSE")
def m1_district(t):
    return feeds.q_coarse(coarse(t), ["cell_id"], district="Nation_1").select("cell_id")


@query("m2_q_fine", "fx_scored", COARSE + "SELECT * FROM coarse ORDER BY cell_id LIMIT 500")
def m2(t):
    return feeds.q_fine(coarse(t), ["cell_id"])


@query("m3_q_forecast_wide", "fx_scored", LONG + f"""
SELECT cell_id, s AS susceptibility_score, h AS forecast_horizon, round(pi, 9) AS ridx, round(rk, 9) AS risk, {q.tier('rk')} AS tier FROM long
WHERE h = '+24h' AND cell_id IN (SELECT cell_id FROM (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS pos FROM fx_scored) x WHERE pos % 10 = 0)""")
def m3(t):
    wide = forecast.to_wide(grid_long(t), ["cell_id", "susceptibility_score"])
    return feeds.q_forecast(wide, ["cell_id"], horizon=" 24h", sample_step=10)


@query("m3_q_forecast_long", "fx_scored", LONG + f"SELECT cell_id, h AS forecast_horizon, round(rk, 9) AS risk FROM long WHERE h = '+6h'")
def m3_long(t):
    return feeds.q_forecast(grid_long(t), ["cell_id", "horizon_h"], horizon="+6h").select("cell_id", "forecast_horizon", "risk")


@query("m4_q_hotspots", "fx_stations", STATION + f"SELECT station_id, forecast_horizon, {q.even('rk', 4)} AS forecast_risk_score FROM station")
def m4(t):
    return feeds.q_hotspots(forecast.station_forecast(t.fx_stations)).select("station_id", "forecast_horizon", "forecast_risk_score")


@query("m5_q_alerts", "fx_stations", alert_plans.HOT + "SELECT station_id, forecast_horizon, alert_severity FROM hot WHERE alert_severity = 'VERY HIGH'")
def m5(t):
    return feeds.q_alerts(alert_plans.hotspots(t), "VERY HIGH").select("station_id", "forecast_horizon", "alert_severity")


@query("m6_q_attribution", "", attribution.X + """
SELECT 'LogisticRegression' AS model, (SELECT count(*) FROM rk) AS features, (SELECT feature FROM rk WHERE rank = 1) AS first_feature,
  s.id AS sample_id, (SELECT feature FROM phi WHERE phi.id = s.id ORDER BY abs(phi) DESC, feature LIMIT 1) AS top_attribution,
  'Attribution is not causal proof.' AS scientific_disclaimer
FROM (SELECT id FROM probs WHERE label = 1 ORDER BY (slide_name IS NOT NULL AND prob > 0.9) DESC, prob DESC, id LIMIT 1) s""")
def m6(t):
    path = new_path(t.spark, "attribution")
    attribution.summary(t).write.json(path)
    stored = feeds.q_attribution(t.spark, path)
    sample = F.col("representative_sample")
    return stored.select(
        "model", F.size("global_features").cast("bigint").alias("features"), F.col("global_features")[0]["feature"].alias("first_feature"),
        sample["sample"]["id"].alias("sample_id"), sample["top_attributions"][0]["feature"].alias("top_attribution"), "scientific_disclaimer")


@query("m7_every_nth", "fx_scored", COARSE + f"SELECT cell_id, risk_score FROM {NTH} x WHERE pos % 7 = 0")
def m7(t):
    return feeds.every_nth(coarse(t), 7, ["cell_id"]).select("cell_id", "risk_score")


@query("m8_normalize_horizon", "fx_alert_candidates", """
SELECT event_id, forecast_horizon AS horizon FROM fx_alert_candidates""")
def m8(t):
    """Horizons as they arrive: plus as a space, missing, doubled."""
    e, h = F.col("event_id"), F.col("forecast_horizon")
    raw = F.when(e % 3 == 0, F.regexp_replace(h, r"^\+", " ")).when(e % 3 == 1, F.substring(h, 2, 9)).otherwise(h)
    return t.fx_alert_candidates.select("event_id", feeds.normalize_horizon(raw).alias("horizon"))


@query("m9_monitor_status", "fx_alert_candidates", alert_plans.KEYED + "SELECT count(*) AS dispatched_keys_count FROM ledger")
def m9(t):
    return feeds.monitor_status(alert_plans.ledger(t))


@query("m10_available_horizons", "fx_alert_candidates", "SELECT DISTINCT forecast_horizon FROM fx_alert_candidates")
def m10(t):
    return feeds.distinct_horizons(t.fx_alert_candidates)
