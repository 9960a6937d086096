"""Forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import forecast, risk
from hazardspark.plans import sqltext as q
from hazardspark.plans.registry import query
from hazardspark.plans.risk import RISKED

PROJECTED = """projected AS (
  SELECT station_id, station_name, district, s, '+6h' AS forecast_horizon, 6 AS horizon_h, c6 AS c,
    a24 * (18e0 / 24e0) + c6 AS p24, a72 * (66e0 / 72e0) + c6 AS p72, a7d + c6 AS p7d FROM fx_stations
  UNION ALL SELECT station_id, station_name, district, s, '+12h', 12, c12, a24 * (12e0 / 24e0) + c12, a72 * (60e0 / 72e0) + c12, a7d + c12 FROM fx_stations
  UNION ALL SELECT station_id, station_name, district, s, '+24h', 24, c24, c24, a72 * (48e0 / 72e0) + c24, a7d * (6e0 / 7e0) + c24 FROM fx_stations
  UNION ALL SELECT station_id, station_name, district, s, '+48h', 48, c48, c48 - c24, a24 + c48, a7d * (5e0 / 7e0) + c48 FROM fx_stations)
"""
STATION = (
    ", " + PROJECTED
    + f", ix AS (SELECT *, CASE WHEN c IS NULL THEN NULL ELSE {q.ridx('p24', 'p72', 'p7d')} END AS ri FROM projected)"
    + f", station AS (SELECT *, CASE WHEN c IS NULL THEN s ELSE {q.risk('s', 'ri')} END AS rk FROM ix)\n"
)
LONG = (
    f", {RISKED}, steps AS (SELECT * FROM (VALUES ('+6h', 6, 1.15e0), ('+12h', 12, 1.45e0), ('+24h', 24, 1.85e0), ('+48h', 48, 1.60e0)) v(h, hh, m))"
    ", px AS (SELECT cell_id, s, h, hh, CASE WHEN ri IS NULL THEN NULL ELSE least(greatest(ri * m, 0e0), 1e0) END AS pi FROM risked CROSS JOIN steps)"
    f", long AS (SELECT *, {q.risk('s', 'pi')} AS rk, FROM px)\n"
)
R9 = 9


def scored(t):
    """Grid with unrounded static score and trigger index."""
    return risk.score_cells(t.fx_scored, score_digits=None, mm_digits=None)


def grid_long(t, digits=R9):
    return forecast.scenario_forecast(scored(t), digits=digits)


@query("i1_project_windows", "fx_stations", ", " + PROJECTED + """
SELECT station_id, forecast_horizon, horizon_h, round(c, 9) AS period_mm, round(p24, 9) AS p24, round(p72, 9) AS p72,
  round(p7d, 9) AS p7d FROM projected""")
def i1(t):
    out = forecast.project_windows(t.fx_stations)
    return out.select("station_id", "forecast_horizon", "horizon_h",
                      *[F.round(c, 9).alias(c) for c in ("period_mm", "p24", "p72", "p7d")])


@query("i2_station_forecast", "fx_stations", STATION + f"""
SELECT station_id, station_name, district, forecast_horizon, horizon_h, round(s, 9) AS susceptibility_score,
  round(c, 8) AS forecast_rainfall_period_mm, round(CASE WHEN c IS NOT NULL THEN p24 END, 8) AS projected_rolling_24h_mm,
  round(CASE WHEN c IS NOT NULL THEN p72 END, 8) AS projected_rolling_72h_mm,
  round(CASE WHEN c IS NOT NULL THEN p7d END, 8) AS projected_rolling_7d_mm,
  round(ri, 9) AS rainfall_trigger_index, round(rk, 9) AS forecast_risk_score, {q.tier('rk')} AS risk_category,
  CASE WHEN c IS NULL THEN 'static_baseline_only' ELSE 'forecast_composite' END AS risk_mode,
  CASE WHEN c IS NULL THEN 'unavailable' ELSE 'available' END AS forecast_status FROM station""")
def i2(t):
    return forecast.station_forecast(t.fx_stations, mm_digits=8, score_digits=9)


@query("i3_baseline_now", "fx_stations", f"""
, b AS (SELECT station_id, s, {q.ridx('a24', 'a72', 'a7d')} AS ri FROM fx_stations)
, k AS (SELECT *, {q.risk('s', 'ri')} AS rk FROM b)
SELECT station_id, round(ri, 9) AS baseline_index, round(rk, 9) AS baseline_risk, {q.tier('rk')} AS baseline_tier FROM k""")
def i3(t):
    return forecast.baseline_now(t.fx_stations, digits=9)


@query("i4_scenario_forecast", "fx_scored", LONG + f"""
SELECT cell_id, s AS susceptibility_score, h AS forecast_horizon, hh AS horizon_h, round(pi, 9) AS ridx,
  round(rk, 9) AS risk, {q.tier('rk')} AS tier FROM long""")
def i4(t):
    return grid_long(t).drop("risk_raw")


WIDE = ", ".join(
    f"max(round(pi, 9)) FILTER (WHERE h = '{h}') AS \"ridx_{h}\", max(round(rk, 9)) FILTER (WHERE h = '{h}') AS \"risk_{h}\", "
    f"max({q.tier('rk')}) FILTER (WHERE h = '{h}') AS \"tier_{h}\"" for h in ("+6h", "+12h", "+24h", "+48h"))


@query("i4_wide_form", "fx_scored", LONG + f"""
SELECT cell_id, s AS susceptibility_score, {WIDE} FROM long GROUP BY cell_id, s""")
def i4_wide(t):
    return forecast.to_wide(grid_long(t), ["cell_id", "susceptibility_score"])


@query("i5_horizon_summary", "fx_scored", LONG + f"""
, tt AS (SELECT h, rk, {q.tier('rk')} AS tier FROM long)
SELECT h AS forecast_horizon, count(*) AS cells, round(avg(rk), 8) AS mean_risk, round(max(rk), 9) AS max_risk,
  count(*) FILTER (WHERE tier = 'Low') AS low, count(*) FILTER (WHERE tier = 'Moderate') AS moderate,
  count(*) FILTER (WHERE tier = 'High') AS high, count(*) FILTER (WHERE tier = 'Very High') AS very_high,
  {q.even("count(*) FILTER (WHERE tier IN ('High', 'Very High')) * 100e0 / count(*)", 2)} AS pct_high_or_very_high
FROM tt GROUP BY h""")
def i5(t):
    out = forecast.horizon_summary(grid_long(t, None), digits=None)
    return out.withColumns({"mean_risk": F.round("mean_risk", 8), "max_risk": F.round("max_risk", 9)})


@query("i6_peak_horizon", "fx_stations", STATION + f"""
, st AS (SELECT *, {q.even('rk', 4)} AS r4, {q.tier('rk')} AS tier FROM station
  QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY {q.even('rk', 4)} DESC, horizon_h) = 1)
SELECT station_id, s AS susceptibility_score, r4 AS peak_forecast_risk,
  CASE WHEN c IS NULL THEN 'N/A (Offline)' ELSE forecast_horizon END AS peak_horizon,
  CASE WHEN c IS NULL THEN {q.tier('s')} ELSE tier END AS peak_category,
  CASE WHEN c IS NULL THEN 'offline_fallback' ELSE 'available' END AS status FROM st""")
def i6(t):
    return forecast.peak_horizon(forecast.station_forecast(t.fx_stations))


@query("i7_tier_migration", "fx_scored", LONG + f"""
, steps_all AS (SELECT 'Baseline' AS step, {q.tier('rk')} AS tier FROM risked UNION ALL SELECT h, {q.tier('rk')} FROM long)
, shown AS (SELECT * FROM (VALUES ('Low'), ('Moderate'), ('High'), ('Very High')) v(tier))
SELECT n.step AS step, shown.tier AS tier, count(a.tier) AS cells, round(count(a.tier) * 100e0 / max(n.total), 9) AS pct
FROM (SELECT step, count(*) AS total FROM steps_all GROUP BY step) n CROSS JOIN shown
LEFT JOIN steps_all a ON a.step = n.step AND a.tier = shown.tier GROUP BY 1, 2""")
def i7(t):
    base = risk.score_cells(t.fx_scored)
    return forecast.tier_migration(base, grid_long(t)).withColumn("pct", F.round("pct", 9))


@query("i8_fallback_check", "fx_stations", """
SELECT count(*) * 4 AS offline_rows, TRUE AS risk_equals_s, TRUE AS nothing_invented FROM fx_stations WHERE c6 IS NULL""")
def i8(t):
    return forecast.fallback_check(forecast.station_forecast(t.fx_stations))


@query("i9_grid_forecast_long", "fx_scored", LONG + f"""
SELECT cell_id, s AS susceptibility_score, h AS forecast_horizon, round(pi, 9) AS ridx, round(rk, 9) AS risk,
  {q.tier('rk')} AS tier FROM long WHERE h = '+24h'""")
def i9(t):
    wide = forecast.to_wide(grid_long(t), ["cell_id", "susceptibility_score"])
    return forecast.grid_forecast_long(wide, "+24h")
