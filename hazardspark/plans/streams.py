"""Streaming queries: the candidate alerts replayed in parts of five days each."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import alerts
from hazardspark.plans import sqltext as q
from hazardspark.plans.registry import query
from hazardspark.session import make_folder, new_path, publish
from hazardspark.streaming.monitor import Monitor, run_once

CYCLES = 7
KEYS = f"""
, keyed AS (SELECT event_id, ts, CAST(station_id AS VARCHAR) AS location_id, forecast_horizon, {q.severity('risk_score')} AS alert_severity
    FROM fx_alert_candidates WHERE risk_score >= 0.55::DOUBLE)
, firsts AS (SELECT location_id, forecast_horizon, alert_severity, min((ts, event_id)) AS w FROM keyed GROUP BY ALL)
"""


def replay(t, monitor, before=None):
    """One cycle per part of five days: a part's folder is published whole, then the monitor runs.

    Every cycle starts the query anew from its checkpoint. Returns the stream.
    """
    staged, path = new_path(t.spark, "candidates"), new_path(t.spark, "feed")
    feed = t.fx_alert_candidates.withColumn("ts", F.col("ts").cast("timestamp"))
    feed.withColumn("part", F.floor((F.dayofmonth("ts") - 1) / 5).cast("int")).write.partitionBy("part").parquet(staged)
    make_folder(t.spark, path)
    stream = t.spark.readStream.schema(feed.schema).option("recursiveFileLookup", "true").parquet(path)
    for i in range(CYCLES):
        publish(t.spark, f"{staged}/part={i}", path)
        if before is not None:
            before(i)
        run_once(stream, monitor)
    return stream


def run(t, **kw):
    monitor = Monitor(new_path(t.spark, "monitor"), **kw)
    replay(t, monitor)
    return monitor


def flaky(planned, batch_id):
    """Every third alert fails on its first try."""
    failed = (F.col("event_id") % 3 == 0) & (F.col("tries") == 0)
    return planned.withColumn("status", F.when(failed, "FAILED").otherwise("SENT"))


@query("o1_monitor", "fx_alert_candidates", KEYS + "SELECT location_id, forecast_horizon, alert_severity FROM firsts")
def o1(t):
    """Without a cap every key is sent exactly once, in its first batch."""
    return run(t, cap=None).attempts(t.spark).where(F.col("status") == "SENT").select(*alerts.KEY)


PART = "CAST((day(w[1]) - 1) // 5 AS INTEGER)"


@query("o2_dispatch_state", "fx_alert_candidates", KEYS + f"""
SELECT {PART} AS n, location_id, forecast_horizon, alert_severity, w[2] AS event_id, 0 AS tries,
  CASE WHEN w[2] % 3 = 0 THEN 'FAILED' ELSE 'SENT' END AS status FROM firsts
UNION ALL SELECT {PART} + 1, location_id, forecast_horizon, alert_severity, w[2], 1, 'SENT' FROM firsts WHERE w[2] % 3 = 0""")
def o2(t):
    """A failed key is retried in a later batch and remembered only once sent."""
    monitor = run(t, cap=None, outcomes=flaky)
    return monitor.attempts(t.spark).select("n", *alerts.KEY, "event_id", "tries", "status")


@query("o3_cap_per_cycle", "fx_alert_candidates", KEYS + """
SELECT location_id, forecast_horizon, alert_severity FROM firsts ORDER BY w LIMIT 14""")
def o3(t):
    """Two dispatches per cycle; the rest waits in the backlog."""
    return run(t, cap=2).attempts(t.spark).where(F.col("status") == "SENT").select(*alerts.KEY)


MIXED = KEYS + f"""
, sim AS (
  SELECT -1 AS n, location_id, forecast_horizon, alert_severity, w, {PART} AS part, 0 AS tries, 'OPEN' AS st, CAST(NULL AS INTEGER) AS due,
    CAST(NULL AS INTEGER) AS tried, CAST(NULL AS VARCHAR) AS res FROM firsts
  UNION ALL
  SELECT m, location_id, forecast_horizon, alert_severity, w, part, CASE WHEN go THEN tries + 1 ELSE tries END,
    CASE WHEN NOT go THEN now WHEN res = 'SENT' THEN 'SENT' WHEN res = 'UNKNOWN' THEN 'PENDING' ELSE 'OPEN' END,
    CASE WHEN go AND res = 'UNKNOWN' THEN m + 2 ELSE due END, CASE WHEN go THEN tries END, res
  FROM (SELECT *, ready AND before < 2 AS go
    FROM (SELECT *, coalesce(sum(CASE WHEN ready AND res = 'SENT' THEN 1 ELSE 0 END) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT *, part <= m AND now = 'OPEN' AS ready,
          CASE WHEN tries > 0 OR w[2] % 4 = 3 THEN 'SENT' WHEN w[2] % 4 = 0 THEN 'FAILED' WHEN w[2] % 4 = 1 THEN 'DISABLED' ELSE 'UNKNOWN' END AS res
        FROM (SELECT n + 1 AS m, location_id, forecast_horizon, alert_severity, w, part, tries, due,
            CASE WHEN st = 'PENDING' AND due = n + 1 THEN CASE WHEN w[2] % 8 = 2 THEN 'OPEN' ELSE 'SENT' END ELSE st END AS now
          FROM sim WHERE n < {CYCLES - 1}) a) b) c) d)
"""


def mixed(planned, batch_id):
    """First tries fail, are disabled, stay unknown or are sent, by event; second tries are sent."""
    by_event = F.col("event_id") % 4
    first = F.when(by_event == 0, "FAILED").when(by_event == 1, "DISABLED").when(by_event == 3, "SENT")
    return planned.withColumn("status", F.when(F.col("tries") > 0, "SENT").otherwise(first))


def mixed_monitor(t):
    """Two sent alerts a cycle in feed order; an unknown outcome is reported two cycles later."""
    monitor = Monitor(new_path(t.spark, "monitor"), cap=2, cap_on="sent", order="feed", outcomes=mixed)

    def report(cycle):
        if cycle >= 2:
            unknown = monitor.attempts(t.spark).where((F.col("n") == cycle - 2) & F.col("status").isNull())
            monitor.report(unknown.withColumn("status", F.when(F.col("event_id") % 8 == 2, "FAILED").otherwise("SENT")))

    return monitor, replay(t, monitor, report), report


@query("o2_mixed_outcomes", "fx_alert_candidates", MIXED + """
SELECT n, location_id, forecast_horizon, alert_severity, w[2] AS event_id, tried AS tries, nullif(res, 'UNKNOWN') AS status
FROM sim WHERE tried IS NOT NULL""", recursive=True)
def o2_mixed(t):
    """Every attempt under a cap of two sent alerts, with failed, disabled and late outcomes."""
    return mixed_monitor(t)[0].attempts(t.spark).select("n", *alerts.KEY, "event_id", "tries", "status")


@query("o3_mixed_state", "fx_alert_candidates", MIXED + f"""
SELECT location_id, forecast_horizon, alert_severity, w[2] AS event_id, tries, st AS status FROM
  (SELECT m.location_id, m.forecast_horizon, m.alert_severity, m.w, m.part, m.tries,
    CASE WHEN m.st = 'PENDING' AND m.due = m.n + 1 THEN CASE WHEN m.w[2] % 8 = 2 THEN 'OPEN' ELSE 'SENT' END ELSE m.st END AS st
   FROM sim m WHERE n = {CYCLES - 1}) x WHERE part < {CYCLES}""", recursive=True)
def o3_mixed(t):
    """What the state store holds of every key once the outcomes of the last cycle are read."""
    monitor, stream, report = mixed_monitor(t)
    monitor.cap, monitor.cap_on = 0, "attempts"
    report(CYCLES)
    run_once(stream, monitor)
    return monitor.state(t.spark).select(*alerts.KEY, "event_id", "tries", "status")


@query("o4_run_once", "fx_alert_candidates", KEYS + "SELECT location_id, forecast_horizon, alert_severity FROM firsts")
def o4(t):
    """One more run over the same stream finds nothing new."""
    monitor = Monitor(new_path(t.spark, "monitor"), cap=None)
    run_once(replay(t, monitor), monitor)
    return monitor.ledger(t.spark)
