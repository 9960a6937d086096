"""Rainfall queries (antecedent windows and audits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import quality, rainfall
from hazardspark.plans.registry import query

# every window of every event, straight from the definition
AT = """looked AS (
  SELECT e.event_id, e.cell_id, e.event_date,
    count(p.precip) FILTER (WHERE lag < 1) AS n1, count(p.precip) FILTER (WHERE lag < 3) AS n3, count(p.precip) AS n7,
    sum(p.precip) FILTER (WHERE lag < 1) AS s1, sum(p.precip) FILTER (WHERE lag < 3) AS s3, sum(p.precip) AS s7
  FROM fx_events_at e CROSS JOIN (SELECT unnest(range(0, 7)) AS lag) l
  LEFT JOIN fx_rain_daily p ON p.cell_id = e.cell_id AND p.d = e.event_date - CAST(l.lag AS INTEGER)
  GROUP BY ALL)
"""
AT_EACH = AT + """, windows AS (SELECT event_id, cell_id, event_date, CASE WHEN n1 = 1 THEN s1 END AS r24,
  CASE WHEN n3 = 3 THEN s3 END AS r72, CASE WHEN n7 = 7 THEN s7 END AS r7d FROM looked)
"""
ROLL = """roll AS (
  SELECT a.cell_id, a.d,
    count(*) FILTER (WHERE a.d - b.d < 3) AS n3, count(*) AS n7, a.precip AS s1,
    sum(b.precip) FILTER (WHERE a.d - b.d < 3) AS s3, sum(b.precip) AS s7
  FROM fx_rain_daily a JOIN fx_rain_daily b ON a.cell_id = b.cell_id AND b.d BETWEEN a.d - 6 AND a.d
  GROUP BY a.cell_id, a.d, a.precip)
"""
WINDOWS = ("r24", "r72", "r7d")


def _round(df, digits=6, cols=WINDOWS):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("f1_antecedent_at", "fx_rain_daily fx_events_at", ", " + AT_EACH + """
SELECT event_id, cell_id, event_date, round(r24, 6) AS r24, round(r72, 6) AS r72, round(r7d, 6) AS r7d FROM windows""")
def f1(t):
    return _round(rainfall.antecedent_at(t.fx_events_at, t.fx_rain_daily)).select(
        "event_id", "cell_id", "event_date", *WINDOWS)


@query("f2_rolling_windows", "fx_rain_daily", ", " + ROLL + """
SELECT cell_id, d, round(s1, 6) AS r24, round(CASE WHEN n3 = 3 THEN s3 END, 6) AS r72,
  round(CASE WHEN n7 = 7 THEN s7 END, 6) AS r7d FROM roll""")
def f2(t):
    return _round(rainfall.rolling_windows(t.fx_rain_daily, span=14))


@query("f2_antecedent_grid", "fx_rain_daily", """
SELECT cell_id,
  round(CASE WHEN count(*) FILTER (WHERE d = DATE '2024-01-20') = 1 THEN sum(precip) FILTER (WHERE d = DATE '2024-01-20') END, 6) AS r24,
  round(CASE WHEN count(*) FILTER (WHERE d >= DATE '2024-01-18') = 3 THEN sum(precip) FILTER (WHERE d >= DATE '2024-01-18') END, 6) AS r72,
  round(CASE WHEN count(*) = 7 THEN sum(precip) END, 6) AS r7d
FROM fx_rain_daily WHERE d BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' GROUP BY cell_id""")
def f2_grid(t):
    return _round(rainfall.antecedent_grid(t.fx_rain_daily, "2024-01-20"))


COVER = """cover AS (
  SELECT q.event_date, q.events, count(a.d) AS days_present
  FROM (SELECT event_date, count(*) AS events FROM fx_events_at WHERE event_date IS NOT NULL GROUP BY event_date) q
  CROSS JOIN (SELECT unnest(range(0, 7)) AS lag) l
  LEFT JOIN (SELECT DISTINCT d FROM fx_rain_daily) a ON a.d = q.event_date - CAST(l.lag AS INTEGER)
  GROUP BY q.event_date, q.events)
"""


@query("f3_lookback_coverage", "fx_rain_daily fx_events_at", ", " + COVER + """
SELECT event_date, events, days_present, days_present = 7 AS complete FROM cover""")
def f3(t):
    return rainfall.lookback_coverage(t.fx_events_at, t.fx_rain_daily).drop("missing_days")


@query("f3_coverage_summary", "fx_rain_daily fx_events_at", ", " + COVER + """
SELECT CAST(sum(events) AS BIGINT) AS dated_events, count(*) AS distinct_dates,
  CAST(coalesce(sum(events) FILTER (WHERE days_present = 7), 0) AS BIGINT) AS complete_events,
  CAST(coalesce(sum(events) FILTER (WHERE days_present < 7), 0) AS BIGINT) AS incomplete_events FROM cover""")
def f3_summary(t):
    return rainfall.coverage_summary(rainfall.lookback_coverage(t.fx_events_at, t.fx_rain_daily))


@query("f3_missing_dates", "fx_rain_daily fx_events_at", """
SELECT q.event_date - CAST(l.lag AS INTEGER) AS d, count(*) AS needed_by
FROM fx_events_at q CROSS JOIN (SELECT unnest(range(0, 7)) AS lag) l
WHERE q.event_date - CAST(l.lag AS INTEGER) NOT IN (SELECT d FROM fx_rain_daily) GROUP BY 1""")
def f3_missing(t):
    return rainfall.missing_dates(rainfall.lookback_coverage(t.fx_events_at, t.fx_rain_daily))


@query("f4_complete_window_only", "fx_rain_daily fx_events_at", ", " + AT + """
SELECT event_id, round(CASE WHEN n7 = 7 THEN s1 END, 6) AS r24, round(CASE WHEN n7 = 7 THEN s3 END, 6) AS r72,
  round(CASE WHEN n7 = 7 THEN s7 END, 6) AS r7d FROM looked""")
def f4(t):
    return _round(rainfall.antecedent_at(t.fx_events_at, t.fx_rain_daily, complete="all")).select("event_id", *WINDOWS)


RAW = """raw AS (SELECT cell_id, d, CASE WHEN cell_id % 7 = 3 THEN -9999e0 WHEN cell_id % 11 = 5 THEN NULL ELSE precip END AS precip
  FROM fx_rain_daily)
"""


def _raw(t):
    c = F.col("cell_id")
    value = F.when(c % 7 == 3, F.lit(-9999.0)).when(c % 11 == 5, F.lit(None)).otherwise(F.col("precip"))
    return t.fx_rain_daily.withColumn("precip", value)


@query("f5_negative_policy_null", "fx_rain_daily", ", " + RAW + """
SELECT cell_id, d, CASE WHEN precip >= 0 THEN precip END AS precip FROM raw""")
def f5_null(t):
    return rainfall.negative_policy(_raw(t))


@query("f5_negative_policy_zero", "fx_rain_daily", ", " + RAW + """
SELECT cell_id, d, CASE WHEN precip >= 0 THEN precip ELSE 0e0 END AS precip FROM raw""")
def f5_zero(t):
    return rainfall.negative_policy(_raw(t), mode="zero")


@query("f6_accumulation_checks", "fx_rain_daily fx_events_at", ", " + AT_EACH + """
SELECT count(*) AS rows,
  count(*) FILTER (WHERE r24 < 0) + count(*) FILTER (WHERE r72 < 0) + count(*) FILTER (WHERE r7d < 0) AS negative_values,
  count(*) FILTER (WHERE r72 < r24 - 1e-5) AS r72_below_r24, count(*) FILTER (WHERE r7d < r72 - 1e-5) AS r7d_below_r72,
  count(*) FILTER (WHERE r24 IS NULL) + count(*) FILTER (WHERE r72 IS NULL) + count(*) FILTER (WHERE r7d IS NULL) AS missing_values,
  count(*) FILTER (WHERE day(event_date) <= 6) AS month_boundary_rows FROM windows WHERE event_date IS NOT NULL""")
def f6(t):
    return rainfall.accumulation_checks(rainfall.antecedent_at(t.fx_events_at, t.fx_rain_daily), tol=1e-5)


def _stored(t):
    """Windows as stored: every 50th event is off by a millimetre in r72."""
    found = rainfall.antecedent_at(t.fx_events_at, t.fx_rain_daily)
    return found.withColumn("r72", F.when(F.col("event_id") % 50 == 0, F.col("r72") + 1.0).otherwise(F.col("r72")))


RECON = """
SELECT count(*) AS rows, {r24} AS max_diff_r24, 0::BIGINT AS mismatch_r24,
  round(max(CASE WHEN event_id % 50 = 0 AND r72 IS NOT NULL THEN 1e0 WHEN r72 IS NOT NULL THEN 0e0 END), 6) AS max_diff_r72,
  count(*) FILTER (WHERE event_id % 50 = 0 AND r72 IS NOT NULL) AS mismatch_r72,
  {r7d} AS max_diff_r7d, 0::BIGINT AS mismatch_r7d,
  count(*) FILTER (WHERE event_id % 50 = 0 AND r72 IS NOT NULL) = 0 AS all_ok
FROM windows {where}"""


def _recon_sql(where):
    zero = "CASE WHEN count({0}) > 0 THEN 0e0 END"
    return ", " + AT_EACH + RECON.format(r24=zero.format("r24"), r7d=zero.format("r7d"), where=where)


def _recon(t, only_date=None):
    again = rainfall.antecedent_at(t.fx_events_at, t.fx_rain_daily)
    out = rainfall.reconcile(_stored(t), again, "event_id", list(WINDOWS), only_date=only_date)
    return out.withColumns({f"max_diff_{c}": F.round(f"max_diff_{c}", 6) for c in WINDOWS})


@query("f7_reconcile", "fx_rain_daily fx_events_at", _recon_sql(""))
def f7(t):
    return _recon(t)


@query("f7_reconcile_one_date", "fx_rain_daily fx_events_at", _recon_sql("WHERE event_date = DATE '2024-01-12'"))
def f7_date(t):
    return _recon(t, F.col("event_date") == F.lit("2024-01-12").cast("date"))


@query("f8_month_boundary_audit", "fx_rain_daily fx_events_at", ", " + AT_EACH + """
SELECT w.event_id, w.event_date, round(w.r24, 6) AS calc_r24, round(w.r72, 6) AS calc_r72, round(w.r7d, 6) AS calc_r7d,
  string_agg(DISTINCT strftime(w.event_date - CAST(l.lag AS INTEGER), '%Y-%m'), ',' ORDER BY strftime(w.event_date - CAST(l.lag AS INTEGER), '%Y-%m')) AS months_used,
  count(p.precip) AS days_known, round(sum(p.precip), 6) AS sum_known,
  NOT (w.event_id % 50 = 0 AND w.r72 IS NOT NULL) AS is_correct
FROM windows w CROSS JOIN (SELECT unnest(range(0, 7)) AS lag) l
LEFT JOIN fx_rain_daily p ON p.cell_id = w.cell_id AND p.d = w.event_date - CAST(l.lag AS INTEGER)
WHERE day(w.event_date) <= 6 GROUP BY w.event_id, w.event_date, w.r24, w.r72, w.r7d""")
def f8(t):
    out = rainfall.month_boundary_audit(_stored(t), t.fx_rain_daily, "event_id")
    known = F.filter("daily_values", lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return out.select(
        "event_id", "event_date", *[F.round(f"calc_{c}", 6).alias(f"calc_{c}") for c in WINDOWS], "months_used",
        F.size(known).cast("bigint").alias("days_known"),
        F.when(F.size(known) > 0, F.round(total, 6)).alias("sum_known"), "is_correct")


@query("f9_rainfall_stats", "fx_rain_daily fx_events_at", ", " + AT_EACH + """
, long AS (SELECT 'r24' AS column_name, r24 AS v FROM windows UNION ALL SELECT 'r72', r72 FROM windows
  UNION ALL SELECT 'r7d', r7d FROM windows)
SELECT column_name, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
  round(stddev_samp(v), 6) AS std, count(*) - count(v) AS missing FROM long GROUP BY column_name""")
def f9(t):
    found = rainfall.antecedent_at(t.fx_events_at, t.fx_rain_daily)
    return quality.column_stats(found, list(WINDOWS), ddof=1, digits=6)


@query("f10_grid_axis_check", "fx_rain_daily", """
SELECT strftime(d, '%Y-%m-') || CAST((day(d) - 1) // 10 AS VARCHAR) AS file,
  count(DISTINCT cell_id // 10) AS lat_i_len, CAST(min(cell_id // 10) AS DOUBLE) AS lat_i_min, CAST(max(cell_id // 10) AS DOUBLE) AS lat_i_max,
  round(CAST(max(cell_id // 10) - min(cell_id // 10) AS DOUBLE) / nullif(count(DISTINCT cell_id // 10) - 1, 0), 4) AS lat_i_step,
  count(DISTINCT cell_id % 10) AS lon_i_len, CAST(min(cell_id % 10) AS DOUBLE) AS lon_i_min, CAST(max(cell_id % 10) AS DOUBLE) AS lon_i_max,
  round(CAST(max(cell_id % 10) - min(cell_id % 10) AS DOUBLE) / nullif(count(DISTINCT cell_id % 10) - 1, 0), 4) AS lon_i_step,
  min(d) AS first_day, max(d) AS last_day, count(DISTINCT d) AS days
FROM fx_rain_daily GROUP BY 1""")
def f10(t):
    d = F.col("d")
    cells = t.fx_rain_daily.select(
        "d", F.expr("cell_id div 10").alias("lat_i"), (F.col("cell_id") % 10).alias("lon_i"),
        F.concat(F.date_format(d, "yyyy-MM-"), F.expr("(day(d) - 1) div 10").cast("string")).alias("file"))
    out = rainfall.grid_axis_check(cells, "file", ["lat_i", "lon_i"])
    return out.withColumns({c: F.round(c, 4) for c in ("lat_i_step", "lon_i_step")})


def _checks(t):
    cover = rainfall.coverage_summary(rainfall.lookback_coverage(t.fx_events_at, t.fx_rain_daily))
    return cover.select(
        F.lit(0).cast("bigint").alias("unreadable_files"), F.lit(0).cast("bigint").alias("points_outside"),
        F.lit(0).cast("bigint").alias("missing_files"), "incomplete_events",
        (F.col("dated_events") >= F.col("complete_events")).alias("counts_ok"),
        (F.col("incomplete_events") == 0).alias("all_complete"))


CHECKS = ", " + COVER + """, checks AS (SELECT 0::BIGINT AS unreadable_files, 0::BIGINT AS points_outside, 0::BIGINT AS missing_files,
  CAST(coalesce(sum(events) FILTER (WHERE days_present < 7), 0) AS BIGINT) AS incomplete_events FROM cover)
"""


@query("f11_verdict", "fx_rain_daily fx_events_at", CHECKS + """
SELECT *, CASE WHEN incomplete_events > 0 THEN 'PARTIAL' ELSE 'PASS' END AS status,
  CASE WHEN incomplete_events > 0 THEN CAST(incomplete_events AS VARCHAR) || ' events without a complete lookback'
  ELSE 'all checks passed' END AS reasons FROM checks""")
def f11(t):
    return rainfall.verdict(_checks(t).drop("counts_ok", "all_complete"))


@query("f11_verdict_per_reading", "fx_rain_daily fx_events_at", ", " + AT_EACH + ", " + RAW + """
, short AS (SELECT cell_id, event_date AS d, count(*) AS n FROM windows WHERE event_date IS NOT NULL AND r7d IS NULL GROUP BY 1, 2)
, found AS (SELECT w.cell_id, w.d, CAST(w.precip IS NULL AS BIGINT) AS unreadable_files, CAST(coalesce(w.precip < 0, FALSE) AS BIGINT) AS points_outside,
    CAST(p.d IS NULL AS BIGINT) AS missing_files, coalesce(s.n, 0) AS incomplete_events
  FROM raw w LEFT JOIN fx_rain_daily p ON p.cell_id = w.cell_id AND p.d = w.d - 1
  LEFT JOIN short s ON s.cell_id = w.cell_id AND s.d = w.d)
SELECT *, CASE WHEN missing_files + incomplete_events > 0 THEN 'PARTIAL' WHEN unreadable_files + points_outside > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN unreadable_files + points_outside + missing_files + incomplete_events = 0 THEN 'all checks passed' ELSE concat_ws('; ',
    CASE WHEN unreadable_files > 0 THEN unreadable_files || ' files could not be read' END,
    CASE WHEN points_outside > 0 THEN points_outside || ' points outside the grid' END,
    CASE WHEN missing_files > 0 THEN missing_files || ' expected files missing' END,
    CASE WHEN incomplete_events > 0 THEN incomplete_events || ' events without a complete lookback' END) END AS reasons
FROM found""")
def f11_per_reading(t):
    """The verdict of every reading, so that each rule can hold and fail."""
    day_before = t.fx_rain_daily.select("cell_id", F.date_add("d", 1).alias("d"), F.lit(True).alias("_before"))
    windows = rainfall.antecedent_at(t.fx_events_at, t.fx_rain_daily)
    short = windows.where(F.col("event_date").isNotNull() & F.col("r7d").isNull()).groupBy(
        "cell_id", F.col("event_date").alias("d")).agg(F.count(F.lit(1)).alias("_short"))
    found = _raw(t).join(day_before, ["cell_id", "d"], "left").join(short, ["cell_id", "d"], "left")
    return rainfall.verdict(found.select(
        "cell_id", "d", F.col("precip").isNull().cast("bigint").alias("unreadable_files"),
        F.coalesce(F.col("precip") < 0, F.lit(False)).cast("bigint").alias("points_outside"),
        F.col("_before").isNull().cast("bigint").alias("missing_files"),
        F.coalesce("_short", F.lit(0)).cast("bigint").alias("incomplete_events")))


@query("f11_verified", "fx_rain_daily fx_events_at", CHECKS + """
SELECT incomplete_events, TRUE AS counts_ok, incomplete_events = 0 AS all_complete,
  CASE WHEN incomplete_events = 0 THEN 'VERIFIED' ELSE 'DATA EXTRACTION ISSUE' END AS decision FROM checks""")
def f11_verified(t):
    out = rainfall.verified(_checks(t), ["counts_ok", "all_complete"])
    return out.select("incomplete_events", "counts_ok", "all_complete", "decision")
