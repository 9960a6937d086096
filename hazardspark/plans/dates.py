"""Date-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import catalogue
from hazardspark.plans.registry import query

CUTOFF = 2000


def _parse(e: str) -> str:
    """One comma part to a date; {r} is the day taken from a range."""
    return f"""coalesce(
  CAST(try_strptime(regexp_extract({e}, '(\\d{{1,2}})\\s*[-&/]\\s*(\\d{{1,2}})\\s+([A-Za-z]+)\\s+(\\d{{4}})', 2) || ' '
    || regexp_extract({e}, '[-&/]\\s*\\d{{1,2}}\\s+([A-Za-z]+\\s+\\d{{4}})', 1), '%d %B %Y') AS DATE),
  CAST(try_strptime(regexp_extract({e}, '\\d{{1,2}}\\s+[A-Za-z]+\\s+\\d{{4}}'), '%d %B %Y') AS DATE))"""


CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(history, '(\\d+)(st|nd|rd|th)', '\\1', 'gi'), "
    "'at\\s+\\d+[:.]\\d+.*', '', 'gi'), '^[ .,;]+|[ .,;]+$', '', 'g')"
)
DATED = f"""dated AS (
  SELECT sl_no, history, CASE WHEN history <> 'NA' THEN
    list_filter(list_transform(list_reverse(string_split({CLEAN}, ',')), lambda p: {_parse('trim(p)')}), lambda d: d IS NOT NULL)[1] END AS event_date
  FROM fx_history)
"""
FIRST = f"""SELECT sl_no, CASE WHEN history <> 'NA' THEN CAST(try_strptime(regexp_extract(regexp_replace(
  list_filter(list_reverse(string_split({CLEAN}, ',')), lambda p: regexp_matches(p, '\\d\\s+[A-Za-z]+\\s+\\d{{4}}'))[1],
  '(\\d+)\\s*-\\s*\\d+\\s+([A-Za-z]+)', '\\1 \\2'), '\\d{{1,2}}\\s+[A-Za-z]+\\s+\\d{{4}}'), '%d %B %Y') AS DATE) END AS event_date FROM fx_history"""
STATUS = f"""CASE WHEN year(event_date) > {CUTOFF} THEN 'suspicious' WHEN event_date IS NOT NULL THEN 'usable'
  WHEN history <> 'NA' AND (contains(lower(history), 'week') OR contains(lower(history), 'mid')) THEN 'ambiguous' ELSE 'undated' END"""
USABLE = f"usable AS (SELECT * FROM dated WHERE year(event_date) <= {CUTOFF})"


def usable(t):
    return catalogue.with_event_date(t.fx_history, cutoff_year=CUTOFF)


@query("c1_event_date", "fx_history", ", " + DATED + "SELECT sl_no, event_date FROM dated")
def c1(t):
    return catalogue.with_event_date(t.fx_history).select("sl_no", "event_date")


@query("c2_event_date_range_start", "fx_history", FIRST)
def c2(t):
    return catalogue.with_event_date(t.fx_history, range_end=False).select("sl_no", "event_date")


@query("c3_classify_dates", "fx_history", ", " + DATED + f"SELECT sl_no, event_date, {STATUS} AS status FROM dated")
def c3(t):
    return catalogue.classify_dates(t.fx_history, cutoff_year=CUTOFF).select("sl_no", "event_date", "status")


@query("c3_status_counts", "fx_history", ", " + DATED + f"SELECT {STATUS} AS status, count(*) AS n FROM dated GROUP BY 1")
def c3_counts(t):
    return catalogue.classify_dates(t.fx_history, cutoff_year=CUTOFF).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("c4_events_per_date", "fx_history", ", " + DATED + f", {USABLE} SELECT event_date, count(*) AS events FROM usable GROUP BY 1")
def c4(t):
    return catalogue.events_per_date(usable(t))


@query("c4_date_span", "fx_history", ", " + DATED + f""", {USABLE}
SELECT count(DISTINCT event_date) AS distinct_dates, count(*) AS dated_events, min(event_date) AS earliest, max(event_date) AS latest FROM usable""")
def c4_span(t):
    return catalogue.date_span(usable(t))


MONTHS = """months AS (SELECT DISTINCT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month FROM (
  SELECT event_date - CAST(l.lag AS INTEGER) AS d FROM usable CROSS JOIN (SELECT unnest(range(0, 7)) AS lag) l) x)
"""


@query("c5_required_months", "fx_history", ", " + DATED + f", {USABLE}, {MONTHS} SELECT * FROM months")
def c5(t):
    return catalogue.required_months(usable(t))


MANIFEST = """manifest AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
  FROM orders WHERE o_orderdate >= '1995-02-01'),
actual AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders WHERE o_orderdate >= '1995-03-01')
"""


def _flags(t):
    d = F.col("o_orderdate")
    month = [F.year(d).alias("year"), F.month(d).alias("month")]
    manifest = t.orders.where(d >= "1995-02-01").select(*month).distinct()
    actual = t.orders.where(d >= "1995-03-01").select(*month).distinct()
    return catalogue.reconcile_sets(catalogue.required_months(usable(t)), manifest, actual, ["year", "month"])


@query("c6_reconcile_sets", "fx_history", ", " + DATED + f", {USABLE}, {MONTHS}, {MANIFEST}" + """
SELECT k.year, k.month, EXISTS (SELECT 1 FROM months x WHERE x.year = k.year AND x.month = k.month) AS in_required,
  EXISTS (SELECT 1 FROM manifest x WHERE x.year = k.year AND x.month = k.month) AS in_manifest,
  EXISTS (SELECT 1 FROM actual x WHERE x.year = k.year AND x.month = k.month) AS in_actual
FROM (SELECT * FROM months UNION SELECT * FROM manifest UNION SELECT * FROM actual) k""")
def c6(t):
    return _flags(t)


@query("c6_reconcile_summary", "fx_history", ", " + DATED + f", {USABLE}, {MONTHS}, {MANIFEST}" + """
SELECT (SELECT count(*) FROM (SELECT * FROM months EXCEPT SELECT * FROM actual)) AS missing,
  (SELECT count(*) FROM (SELECT * FROM actual EXCEPT SELECT * FROM months)) AS unexpected, FALSE AS all_equal""")
def c6_summary(t):
    return catalogue.reconcile_summary(_flags(t))


PATTERN = r"^rain-v2\.0\.(\d{4})\.(\d{2})\.days\.nc$"


@query("c7_parse_file_names", "", r"""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'rain-v2.' ELSE 'rain-v2.0.' END || strftime(o_orderdate, '%Y.%m') || '.days.nc' AS name FROM orders)
SELECT o_orderkey, name, regexp_full_match(name, 'rain-v2\.0\.\d{4}\.\d{2}\.days\.nc') AS matched,
  TRY_CAST(nullif(regexp_extract(name, '^rain-v2\.0\.(\d{4})\.(\d{2})\.days\.nc$', 1), '') AS INTEGER) AS year,
  TRY_CAST(nullif(regexp_extract(name, '^rain-v2\.0\.(\d{4})\.(\d{2})\.days\.nc$', 2), '') AS INTEGER) AS month FROM f""")
def c7(t):
    prefix = F.when(F.col("o_orderstatus") == "P", "rain-v2.").otherwise("rain-v2.0.")
    name = F.concat(prefix, F.date_format("o_orderdate", "yyyy.MM"), F.lit(".days.nc"))
    return catalogue.parse_file_names(t.orders.select("o_orderkey", name.alias("name")), "name", PATTERN)
