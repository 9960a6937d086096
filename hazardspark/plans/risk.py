"""Dynamic risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.functions.risk import rain_index, risk_score
from hazardspark.functions.tiers import risk_tier
from hazardspark.operators import rainfall, risk
from hazardspark.operators.ordering import first_per_key
from hazardspark.plans import sqltext as q
from hazardspark.plans.rainfall import ROLL
from hazardspark.plans.registry import query

INDEXED = f"indexed AS (SELECT *, {q.ridx('r24', 'r72', 'r7d')} AS ri FROM fx_scored)"
RISKED = f"{INDEXED}, risked AS (SELECT *, {q.risk('s', 'ri')} AS rk FROM indexed)"


@query("h1_rain_index", "fx_scored", f"""
SELECT cell_id, round({q.ridx('r24', 'r72', 'r7d')}, 10) AS rain_index FROM fx_scored""")
def h1(t):
    return t.fx_scored.select("cell_id", F.round(
        rain_index(F.col("r24"), F.col("r72"), F.col("r7d")), 10).alias("rain_index"))


@query("h2_risk_score", "fx_scored", f", {RISKED} SELECT cell_id, round(rk, 10) AS risk_score FROM risked")
def h2(t):
    index = rain_index(F.col("r24"), F.col("r72"), F.col("r7d"))
    return t.fx_scored.select("cell_id", F.round(risk_score(F.col("s"), index), 10).alias("risk_score"))


@query("h3_risk_tier", "fx_scored", f", {INDEXED} SELECT cell_id, {q.tier('ri')} AS tier FROM indexed")
def h3(t):
    return t.fx_scored.select("cell_id", risk_tier(
        rain_index(F.col("r24"), F.col("r72"), F.col("r7d"))).alias("tier"))


@query("h4_risk_mode", "fx_scored", """
SELECT cell_id, CASE WHEN r24 IS NULL THEN 'static_baseline_only' ELSE 'dynamic_composite' END AS risk_mode,
  CASE WHEN r24 IS NULL THEN 'unavailable' ELSE 'available' END AS rainfall_status FROM fx_scored""")
def h4(t):
    return risk.score_cells(t.fx_scored).select("cell_id", "risk_mode", "rainfall_status")


@query("h5_enrich_risk", "fx_rain_daily fx_scored", f"""
, rain AS (SELECT cell_id,
  CASE WHEN count(*) FILTER (WHERE d = DATE '2024-01-20') = 1 THEN sum(precip) FILTER (WHERE d = DATE '2024-01-20') END AS r24,
  CASE WHEN count(*) FILTER (WHERE d >= DATE '2024-01-18') = 3 THEN sum(precip) FILTER (WHERE d >= DATE '2024-01-18') END AS r72,
  CASE WHEN count(*) = 7 THEN sum(precip) END AS r7d
  FROM fx_rain_daily WHERE d BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' GROUP BY cell_id)
, g AS (SELECT x.cell_id, x.s, x.slope, r.r24, r.r72, r.r7d FROM fx_scored x LEFT JOIN rain r ON r.cell_id = x.cell_id)
, i AS (SELECT *, {q.ridx('r24', 'r72', 'r7d')} AS ri FROM g), k AS (SELECT *, {q.risk('s', 'ri')} AS rk FROM i)
SELECT cell_id, s, slope, round(r24, 8) AS rainfall_24h, round(r72, 8) AS rainfall_72h, round(r7d, 8) AS rainfall_7d,
  round(ri, 9) AS rainfall_trigger_index, round(s, 9) AS susceptibility_score, round(rk, 9) AS risk_score,
  {q.tier('rk')} AS risk_category,
  CASE WHEN ri IS NULL THEN 'static_baseline_only' ELSE 'dynamic_composite' END AS risk_mode,
  CASE WHEN ri IS NULL THEN 'unavailable' ELSE 'available' END AS rainfall_status FROM k""")
def h5(t):
    grid = t.fx_scored.select("cell_id", "s", "slope")
    return risk.enrich_risk(grid, t.fx_rain_daily, "2024-01-20", mm_digits=8, score_digits=9)


@query("h5_stored_scores", "fx_scored", f", {RISKED}" + f"""
SELECT cell_id, {q.even('r24', 2)} AS rainfall_24h, {q.even('ri', 4)} AS rainfall_trigger_index,
  {q.even('rk', 4)} AS risk_score, {q.tier('rk')} AS risk_category FROM risked""")
def h5_stored(t):
    return risk.score_cells(t.fx_scored).select(
        "cell_id", "rainfall_24h", "rainfall_trigger_index", "risk_score", "risk_category")


@query("h6_tier_counts", "fx_scored", f", {RISKED}" + f"""
, tiers AS (SELECT {q.tier('rk')} AS tier FROM risked)
, shown AS (SELECT * FROM (VALUES (0, 'Low'), (1, 'Moderate'), (2, 'High'), (3, 'Very High')) v(tier_order, tier))
SELECT tier_order, shown.tier AS tier, count(tiers.tier) AS cells,
  round(count(tiers.tier) * 100e0 / (SELECT count(*) FROM tiers), 9) AS pct
FROM shown LEFT JOIN tiers ON tiers.tier = shown.tier GROUP BY 1, 2""")
def h6(t):
    scored = risk.score_cells(t.fx_scored)
    return risk.tier_counts(scored, "risk_category").withColumn("pct", F.round("pct", 9))


@query("h6_score_summary", "fx_scored", f", {RISKED}" + """
, long AS (SELECT 'susceptibility_score' AS measure, s AS v FROM risked
  UNION ALL SELECT 'rainfall_trigger_index', ri FROM risked UNION ALL SELECT 'risk_score', rk FROM risked)
SELECT measure, count(v) AS n, round(avg(v), 8) AS mean, round(min(v), 9) AS min, round(max(v), 9) AS max
FROM long GROUP BY measure""")
def h6_summary(t):
    scored = risk.score_cells(t.fx_scored, score_digits=None)
    out = risk.score_summary(scored, ["susceptibility_score", "rainfall_trigger_index", "risk_score"], None)
    return out.withColumns({"mean": F.round("mean", 8), "min": F.round("min", 9), "max": F.round("max", 9)})


@query("risk_chain", "fx_rain_daily fx_scored", ", " + ROLL + f"""
, last AS (SELECT * FROM roll WHERE n7 = 7 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY d DESC) = 1)
, g AS (SELECT x.cell_id, x.s, l.s1 AS r24, l.s3 AS r72, l.s7 AS r7d
  FROM fx_scored x LEFT JOIN last l ON l.cell_id = x.cell_id % (SELECT max(cell_id) + 1 FROM fx_rain_daily))
, i AS (SELECT *, {q.ridx('r24', 'r72', 'r7d')} AS ri FROM g), k AS (SELECT *, {q.risk('s', 'ri')} AS rk FROM i)
, tiers AS (SELECT {q.tier('rk')} AS tier FROM k)
, shown AS (SELECT * FROM (VALUES (0, 'Low'), (1, 'Moderate'), (2, 'High'), (3, 'Very High')) v(tier_order, tier))
SELECT tier_order, shown.tier AS tier, count(tiers.tier) AS cells,
  round(count(tiers.tier) * 100e0 / (SELECT count(*) FROM tiers), 9) AS pct
FROM shown LEFT JOIN tiers ON tiers.tier = shown.tier GROUP BY 1, 2""")
def risk_chain(t):
    windows = rainfall.rolling_windows(t.fx_rain_daily).where(F.col("r7d").isNotNull())
    latest = first_per_key(windows, ["cell_id"], [F.desc("d")])
    rain = latest.select(F.col("cell_id").alias("rain_cell"), "r24", "r72", "r7d")
    cells = t.fx_rain_daily.agg(F.max("cell_id") + 1).scalar()
    grid = t.fx_scored.select("cell_id", "s", (F.col("cell_id") % cells).alias("rain_cell"))
    scored = risk.score_cells(grid.join(rain, "rain_cell", "left"))
    return risk.tier_counts(scored, "risk_category").withColumn("pct", F.round("pct", 9))
