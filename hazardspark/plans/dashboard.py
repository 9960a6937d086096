"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import dashboard, forecast
from hazardspark.plans import alerts as alert_plans
from hazardspark.plans import sqltext as q
from hazardspark.plans.feeds import COARSE, coarse
from hazardspark.plans.forecast import LONG, STATION, grid_long
from hazardspark.plans.quality import ISNUM
from hazardspark.plans.registry import query

BUCKET = ("CASE WHEN contains(upper(coalesce({0}, '')), 'VERY') THEN 'VERY HIGH' WHEN contains(upper(coalesce({0}, '')), 'HIGH') THEN 'HIGH' "
          "WHEN contains(upper(coalesce({0}, '')), 'MODERATE') THEN 'MODERATE' ELSE 'LOW' END")


@query("n1_harmonize", "fx_raw_points", f"""
, a AS (SELECT district, material, CASE WHEN {ISNUM.format('latitude')} THEN CAST(latitude AS DOUBLE) END AS _lat,
  CASE WHEN {ISNUM.format('longitude')} THEN CAST(longitude AS DOUBLE) END AS _lon FROM fx_raw_points)
SELECT district, _lat, _lon, district AS _key FROM a WHERE _lat BETWEEN -90 AND 90 AND _lon BETWEEN -180 AND 180""")
def n1(t):
    raw = t.fx_raw_points.select("district", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), F.col("district").alias("id"))
    return dashboard.harmonize(raw).select("district", "_lat", "_lon", "_key")


@query("n2_severity_contains", "fx_stations", alert_plans.HOT + "SELECT station_id, forecast_horizon, alert_severity FROM hot WHERE contains(alert_severity, 'HIGH')")
def n2(t):
    return dashboard.severity_contains(alert_plans.hotspots(t), "HIGH").select("station_id", "forecast_horizon", "alert_severity")


@query("n3_kpis", "fx_scored fx_stations", COARSE + alert_plans.HOT + f"""
SELECT (SELECT count(*) FROM coarse) AS total_cells, (SELECT count(*) FROM coarse WHERE {BUCKET.format('risk_category')} = 'HIGH') AS high_cells,
  (SELECT count(*) FROM coarse WHERE {BUCKET.format('risk_category')} = 'VERY HIGH') AS very_high_cells, (SELECT count(*) FROM hot) AS active_alerts,
  (SELECT round(max(risk_score), 3) FROM coarse) AS max_risk""")
def n3(t):
    return dashboard.kpis(coarse(t), alert_plans.hotspots(t), tier="risk_category")


@query("n4_tier_distribution", "fx_scored", COARSE + f"""
SELECT b.name, count(c.cell_id) AS count FROM (VALUES ('LOW'), ('MODERATE'), ('HIGH'), ('VERY HIGH')) b(name)
LEFT JOIN coarse c ON {BUCKET.format('c.risk_category')} = b.name GROUP BY b.name""")
def n4(t):
    return dashboard.tier_distribution(coarse(t), "risk_category")


@query("n5_tier_priority_sort", "fx_scored", COARSE + """
SELECT cell_id, risk_tier, CASE risk_tier WHEN 'Very High' THEN 4 WHEN 'High' THEN 3 WHEN 'Moderate' THEN 2 ELSE 1 END AS priority FROM coarse""")
def n5(t):
    return dashboard.tier_priority_sort(coarse(t), "cell_id").select("cell_id", "risk_tier", "priority")


@query("n6_horizon_stats", "fx_scored", LONG + f"""
, k AS (SELECT round(rk, 9) AS rk, {BUCKET.format(q.tier('rk'))} AS b FROM long WHERE h = '+24h')
SELECT round(max(rk), 3) AS max, round(avg(rk), 3) AS avg, count(*) FILTER (WHERE b = 'HIGH') AS high_count, count(*) FILTER (WHERE b = 'VERY HIGH') AS very_high_count FROM k""")
def n6(t):
    wide = forecast.to_wide(grid_long(t), ["cell_id", "susceptibility_score"])
    return dashboard.horizon_stats(wide, "+24h")


@query("n7_top_hotspots", "fx_stations", STATION + f"""
SELECT station_id, forecast_horizon, {q.even('rk', 4)} AS forecast_risk_score FROM station ORDER BY 3 DESC, station_id, horizon_h LIMIT 5""")
def n7(t):
    return dashboard.top_hotspots(forecast.station_forecast(t.fx_stations)).select("station_id", "forecast_horizon", "forecast_risk_score")


@query("n8_risk_profile", "fx_scored", COARSE + """
SELECT cell_id, CASE WHEN cell_id % 2 = 0 THEN CAST(s AS VARCHAR) ELSE 'N/A' END AS profile_susceptibility, 'N/A' AS profile_rainfall,
  CAST(risk_score AS VARCHAR) AS profile_risk, risk_category AS profile_tier FROM coarse""")
def n8(t):
    named = coarse(t).select("cell_id", F.when(F.col("cell_id") % 2 == 0, F.col("s")).alias("susceptibility"),
                             F.col("risk_score").alias("risk"), "risk_category")
    out = dashboard.risk_profile(named)
    return out.select("cell_id", "profile_susceptibility", "profile_rainfall", "profile_risk", "profile_tier")


@query("n9_feed_stats", "fx_scored", COARSE + """
SELECT count(*) AS total, count(*) FILTER (WHERE contains(risk_category, 'High')) AS high, count(*) FILTER (WHERE contains(risk_category, 'Very')) AS very_high,
  min(risk_score) AS min_score, max(risk_score) AS max_score FROM coarse""")
def n9(t):
    return dashboard.feed_stats(coarse(t), "risk_category")
