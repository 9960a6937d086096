"""The monitor: replay, restart, retry, cap, late outcomes and backlog."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from hazardspark.operators import alerts
from hazardspark.session import new_path
from hazardspark.streaming.monitor import ATTEMPT_DDL, OPEN_DDL, Monitor, run_once, start, supervise

SCHEMA = "event_id long, ts timestamp, station_id long, forecast_horizon string, risk_score double"
HOUR = 3_600_000_000
FIRST = [(1, 1, "+6h", 0.6), (2, 1, "+6h", 0.6), (3, 2, "+6h", 0.8), (4, 3, "+6h", 0.1), (5, 4, "+6h", 0.9)]
SECOND = [(6, 1, "+6h", 0.7), (7, 1, "+6h", 0.76), (8, 5, "+24h", 0.55)]


def batch(spark, rows):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(e, day + dt.timedelta(hours=e), s, h, r) for e, s, h, r in rows], SCHEMA)


def feed(spark, rows, path=None):
    path = path or new_path(spark, "feed")
    batch(spark, rows).write.mode("append").parquet(path)
    return path, spark.readStream.schema(SCHEMA).parquet(path)


def monitor(spark, **kw):
    return Monitor(new_path(spark, "monitor"), **kw)


def fail_once(planned, batch_id):
    failed = (F.col("event_id") == 3) & (F.col("tries") == 0)
    return planned.withColumn("status", F.when(failed, "FAILED").otherwise("SENT"))


def sent(spark, m):
    rows = m.attempts(spark).where(F.col("status") == "SENT").collect()
    return sorted((r.n, r.location_id, r.alert_severity) for r in rows)


def status(spark, m):
    return {r.location_id: (r.status, r.tries) for r in m.state(spark).collect()}


def test_cap_backlog_retry_and_restart(spark):
    m = monitor(spark, cap=2, outcomes=fail_once)
    path, stream = feed(spark, FIRST)
    run_once(stream, m)
    assert sent(spark, m) == [(0, "1", "HIGH")]  # key of event 3 failed and used an attempt
    feed(spark, SECOND, path)
    run_once(stream, m)
    assert sent(spark, m)[1:] == [(1, "1", "VERY HIGH"), (1, "4", "VERY HIGH")]
    again = Monitor(m.root, cap=2)  # a new process with the same folder
    for _ in range(3):
        run_once(stream, again)
    done = sent(spark, m)
    assert [k for _, k, _ in done].count("2") == 1
    assert len({(k, s) for _, k, s in done}) == len(done) == 5
    assert again.ledger(spark).count() == 5


def test_a_batch_run_again_overwrites_its_attempts(spark):
    m = monitor(spark, cap=1)
    rows = spark.createDataFrame([("1", "+6h", "HIGH", 2 * HOUR, 2, 0.6, 0), ("2", "+6h", "HIGH", HOUR, 1, 0.7, 0)], OPEN_DDL)
    m.cycle(rows, 0)
    m.cycle(rows, 0)
    got = m.attempts(spark).collect()
    assert [(r.location_id, r.n, r.status, r.ts) for r in got] == [("2", 0, "SENT", dt.datetime(1970, 1, 1, 1))]


def test_attempts_read_twice_change_nothing(spark):
    m = monitor(spark, cap=None, outcomes=fail_once)
    path, stream = feed(spark, FIRST)
    run_once(stream, m)
    twice = m.attempts(spark).select(*[f.split()[0] for f in ATTEMPT_DDL.split(", ")])
    twice.write.parquet(f"{m.root}/attempts/n=99")  # the same attempts under a second name
    run_once(stream, m)
    assert status(spark, m) == {"1": ("SENT", 1), "2": ("OPEN", 1), "4": ("SENT", 1)}


def test_backlog_drains_without_new_data(spark):
    m = monitor(spark, cap=1)
    query = start(feed(spark, FIRST)[1], m, every="1 second")
    try:
        deadline = time.time() + 120
        while time.time() < deadline:
            try:
                if len(sent(spark, m)) == 3:
                    break
            except Exception:  # a cycle is being written
                pass
            time.sleep(1)
    finally:
        query.stop()
    got = sent(spark, m)
    assert len(got) == 3 and len({n for n, _, _ in got}) == 3


def test_failed_cycle_is_run_again(spark):
    calls = []

    def flaky(planned, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("delivery table not there yet")
        if len(calls) > 3:
            for q in spark.streams.active:
                q.stop()
        return planned.withColumn("status", F.lit("SENT"))

    m = monitor(spark, cap=2, outcomes=flaky)
    assert supervise(feed(spark, FIRST)[1], m, every="1 second", restarts=2) == 1
    assert calls[:2] == [0, 0] and [k for _, k, _ in sent(spark, m)] == ["1", "2", "4"]


def test_keys_use_station_and_severity(spark):
    keyed = alerts.with_key(batch(spark, FIRST)).select(*alerts.KEY).collect()
    assert ("2", "+6h", "VERY HIGH") in [tuple(r) for r in keyed]


@pytest.mark.parametrize("value,want", [("0.7", 0.7), ("bad", 0.0), (None, 0.3), ("NaN", 0.0)])
def test_resolve_risk(spark, value, want):
    df = spark.createDataFrame([(value, 0.3)], "risk_score string, risk double")
    assert alerts.resolve_risk(df).first().risk_score == want


def test_late_outcomes_settle_pending_keys(spark):
    def unknown(planned, batch_id):
        return planned.withColumn("status", F.lit(None).cast("string"))

    m = monitor(spark, cap=2, outcomes=unknown)
    path, stream = feed(spark, FIRST)
    run_once(stream, m)
    run_once(stream, m)  # the pending keys wait, the third is planned
    assert status(spark, m) == {"1": ("PENDING", 1), "2": ("PENDING", 1), "4": ("OPEN", 0)}
    keys = {r.location_id: r for r in m.state(spark).collect()}
    known = [(k, *list(keys[k])[1:3], s) for k, s in (("1", "SENT"), ("2", "FAILED"), ("2", None))]
    m.report(spark.createDataFrame([*known, ("9", "+6h", "HIGH", "SENT")], "location_id string, forecast_horizon string, alert_severity string, status string"))
    run_once(stream, m)
    assert status(spark, m) == {"1": ("SENT", 1), "2": ("OPEN", 1), "4": ("PENDING", 1)}  # key 9 was never planned
    assert [r.location_id for r in m.ledger(spark).collect()] == ["1"]
    assert sorted((r.n, r.location_id, r.tries) for r in m.attempts(spark).collect()) == [
        (0, "1", 0), (0, "2", 0), (1, "4", 0), (2, "2", 1)]


def test_cap_on_sent_and_a_cap_of_zero(spark):
    def failing(planned, batch_id):
        return planned.withColumn("status", F.when(F.col("event_id") < 4, "FAILED").otherwise("SENT"))

    m = monitor(spark, cap=1, outcomes=failing, cap_on="sent", order="feed")
    path, stream = feed(spark, FIRST)
    run_once(stream, m)
    assert [k for _, k, _ in sent(spark, m)] == ["4"]  # two failures did not use up the cap
    m.cap, m.cap_on = 0, "attempts"
    run_once(stream, m)
    assert status(spark, m) == {"1": ("OPEN", 1), "2": ("OPEN", 1), "4": ("SENT", 1)}
    assert m.attempts(spark).where("n = 1").count() == 0


def test_undated_and_repeated_alerts(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(7, day, 1, "+6h", 0.6), (7, day, 1, "+6h", 0.6), (3, None, 2, "+6h", 0.6), (2, day, 2, "+6h", 0.6),
            (None, day, None, "+6h", 0.9), (9, day, 5, None, None)]
    path = new_path(spark, "feed")
    spark.createDataFrame(rows * 3, SCHEMA).repartition(4).write.parquet(path)
    m = monitor(spark, cap=None)
    run_once(spark.readStream.schema(SCHEMA).parquet(path), m)
    got = {r.location_id: (r.event_id, r.ts) for r in m.attempts(spark).collect()}
    assert got == {"1": (7, day), "2": (3, None), None: (None, day)}  # an undated alert comes first
