"""Continuous alert monitor on Spark's keyed state.

One micro-batch is one monitoring cycle. The query reads three streams: the alert
feed, its own attempts (``root/attempts``) and outcomes that become known later
(``root/late``, filled by :meth:`Monitor.report`). ``transformWithState`` keeps one
entry per alert key, in the state store below ``root/checkpoint``:

    OPEN      waits for a dispatch; a timer puts it before every cycle
    PENDING   tried, outcome not known yet; only a late outcome moves it
    SENT      settled for good; costs a cycle nothing

A cycle takes the open keys in order up to the cap, asks for their outcomes and
writes them as ``attempts/n=<batch>``, which the next cycle reads back: SENT settles
a key, FAILED and DISABLED open it again with one try more. Spark may replay a
batch: it overwrites its own folder, which no later batch has read by then. The
first alert of a key, by time and event, is the one that is sent. Delivery beyond
the attempts table is at least once.

Of several alerts of a key within one Arrow batch only the first is shuffled, so a
key that fills the feed costs its task one row a batch, not the whole feed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from hazardspark.operators import alerts
from hazardspark.session import make_folder

Outcomes = Callable[[DataFrame, int], DataFrame]
KEY_DDL = "location_id string, forecast_horizon string, alert_severity string"
OPEN_DDL = f"{KEY_DDL}, us bigint, event_id bigint, risk_score double, tries int"
ATTEMPT_DDL = f"{KEY_DDL}, ts timestamp, event_id bigint, risk_score double, tries int, status string"
LATE_DDL = f"{KEY_DDL}, status string"
INPUT = ["kind", *alerts.KEY, "us", "event_id", "risk_score", "tries", "status"]
INPUT_DDL = f"kind int, {OPEN_DDL}, status string"
ALERT, ATTEMPT, LATE = 0, 1, 2
ORDERS = {"untried": ["tries", "ts", "event_id"], "feed": ["ts", "event_id"]}


def all_sent(planned: DataFrame, batch_id: int) -> DataFrame:
    """Outcome hook that reports every planned alert as delivered."""
    return planned.withColumn("status", F.lit("SENT"))


def _firsts(keys: list[str], columns: list[str]):
    """Per Arrow batch the first alert of each key."""
    def firsts(batches: Iterator) -> Iterator:
        for rows in batches:
            rows = rows.sort_values(["us", "event_id"], na_position="first", kind="stable")
            yield rows.drop_duplicates(keys)[columns]

    return firsts


def _dispatch_state():
    """The entry of one alert key; defined here so that it travels with the tasks."""
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    names = ["us", "event_id", "risk_score", "tries", "status", "due"]
    kinds = (ALERT, ATTEMPT, LATE)

    class DispatchState(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.entry = handle.getValueState(
                "entry", "us bigint, event_id bigint, risk_score double, tries int, status string, due bigint")

        def handleInputRows(self, key, rows, timerValues):
            old = self.entry.get() if self.entry.exists() else None
            first, tried, late = None, [], []
            for row in rows:
                if row.kind == kinds[0]:
                    place = (row.us is not None, row.us or 0, row.event_id is not None, row.event_id or 0)
                    if old is None and (first is None or place < first[0]):
                        first = (place, row)
                elif row.kind == kinds[1]:
                    tried.append((row.tries, row.status))
                else:
                    late.append(row.status)
            if old is not None:
                entry = dict(zip(names, old))
            elif first is not None:
                row = first[1]
                entry = dict(zip(names, (row.us, row.event_id, row.risk_score, 0, "OPEN", None)))
            else:
                return  # an outcome of a key that was never planned
            for tries, status in sorted(tried, key=lambda t: t[0]):
                if entry["status"] != "SENT" and tries >= entry["tries"]:
                    entry["tries"] = tries + 1
                    entry["status"] = "PENDING" if status is None else "SENT" if status == "SENT" else "OPEN"
            if "SENT" in late:
                entry["status"] = "SENT"
            elif late and entry["status"] == "PENDING":
                entry["status"] = "OPEN"
            if entry["due"] is not None:
                self.handle.deleteTimer(entry["due"])
                entry["due"] = None
            yield from self._store(key, entry, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            entry = dict(zip(names, self.entry.get()))
            entry["due"] = None
            yield from self._store(key, entry, timerValues)

        def _store(self, key, entry, timerValues):
            """Keep the entry; an open one is put before this cycle and, by timer, the next."""
            if entry["status"] == "OPEN":
                entry["due"] = timerValues.getCurrentProcessingTimeInMs() + 1
                self.handle.registerTimer(entry["due"])
            self.entry.update(tuple(entry[n] for n in names))
            if entry["status"] == "OPEN":
                yield Row(location_id=key[0], forecast_horizon=key[1], alert_severity=key[2], us=entry["us"],
                          event_id=entry["event_id"], risk_score=entry["risk_score"], tries=entry["tries"])

        def close(self):
            pass

    return DispatchState()


@dataclass
class Monitor:
    """Dispatch state below ``root`` and the rules of one cycle.

    ``outcomes`` gets the planned rows and adds ``status`` (NULL: not known yet);
    on a cluster it joins the results written by whatever drains the outbox.
    ``order`` is ``untried`` (untried keys come first, so one failing key cannot
    hold up the queue) or ``feed`` (a retry keeps its place in the feed).
    ``cap_on`` says what the cap counts: ``attempts``, or only those that were
    ``sent``, in which case failures do not use it up.
    """

    root: str
    cap: int | None = 2
    outcomes: Outcomes = all_sent
    cap_on: str = "attempts"
    order: str = "untried"

    def attempts(self, spark: SparkSession) -> DataFrame:
        """Every attempt with its cycle ``n``."""
        return spark.read.schema(f"{ATTEMPT_DDL}, n int").parquet(f"{self.root}/attempts")

    def state(self, spark: SparkSession) -> DataFrame:
        """Every key with its status as of the last finished cycle, from the state store."""
        rows = spark.read.format("statestore").option("stateVarName", "entry").load(f"{self.root}/checkpoint")
        return rows.select(*[F.col(f"key.{k}").alias(k) for k in alerts.KEY], F.timestamp_micros("value.us").alias("ts"),
                           "value.event_id", "value.risk_score", "value.tries", "value.status")

    def ledger(self, spark: SparkSession) -> DataFrame:
        """Keys that were sent: those settled in the state and those of the last cycle, which it has yet to read."""
        tried = self.attempts(spark)
        last = tried.where(F.col("n") == tried.agg(F.max("n")).scalar())
        sent = [df.where(F.col("status") == "SENT").select(*alerts.KEY) for df in (self.state(spark), last)]
        return sent[0].unionByName(sent[1]).distinct()

    def report(self, outcomes: DataFrame) -> None:
        """Hand in outcomes (key columns, ``status``) of pending keys; the next cycle reads them."""
        known = outcomes.where(F.col("status").isNotNull()).select(*alerts.KEY, "status")
        known.write.mode("append").parquet(f"{self.root}/late")

    def open_keys(self, stream: DataFrame) -> DataFrame:
        """Stream of the keys that wait for a dispatch in each cycle."""
        spark = stream.sparkSession
        for name in ("attempts", "late"):
            make_folder(spark, f"{self.root}/{name}")
        none = F.lit(None)
        feed = alerts.with_key(alerts.eligible(alerts.resolve_risk(stream))).select(
            F.lit(ALERT).alias("kind"), *alerts.KEY, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
            F.col("event_id").cast("bigint").alias("event_id"), "risk_score", none.cast("int").alias("tries"),
            none.cast("string").alias("status"))
        feed = feed.mapInPandas(_firsts(alerts.KEY, INPUT), INPUT_DDL)
        source = spark.readStream.option("recursiveFileLookup", "true")
        tried = source.schema(ATTEMPT_DDL).parquet(f"{self.root}/attempts").withColumns(
            {"kind": F.lit(ATTEMPT), "us": F.unix_micros("ts")})
        late = source.schema(LATE_DDL).parquet(f"{self.root}/late").withColumns({
            "kind": F.lit(LATE), "us": none.cast("bigint"), "event_id": none.cast("bigint"),
            "risk_score": none.cast("double"), "tries": none.cast("int")})
        rows = feed.unionByName(tried.select(*INPUT)).unionByName(late.select(*INPUT))
        return rows.groupBy(*alerts.KEY).transformWithState(_dispatch_state(), OPEN_DDL, "Append", "ProcessingTime")

    def cycle(self, waiting: DataFrame, batch_id: int) -> None:
        """One cycle: plan the open keys up to the cap and store the outcomes."""
        # The keys come out of the state once a cycle, and all of them, whatever the hook or a cap of 0 leaves unread.
        waiting = waiting.persist()
        waiting.write.format("noop").mode("overwrite").save()
        planned = waiting.withColumn("ts", F.timestamp_micros("us")).drop("us")
        order = ORDERS[self.order]
        if self.cap is not None and self.cap_on == "attempts":
            planned = planned.orderBy(*order).limit(self.cap)
        tried = self.outcomes(planned, batch_id)
        if self.cap is not None and self.cap_on == "sent":
            tried = _until_sent(tried, order, self.cap)
        columns = [f.split()[0] for f in ATTEMPT_DDL.split(", ")]
        try:
            tried.select(*columns).write.mode("overwrite").parquet(f"{self.root}/attempts/n={batch_id}")
        finally:
            waiting.unpersist()

    def writer(self, stream: DataFrame):
        return self.open_keys(stream).writeStream.foreachBatch(self.cycle).outputMode("append").option(
            "checkpointLocation", f"{self.root}/checkpoint")


def _until_sent(tried: DataFrame, order: list[str], cap: int) -> DataFrame:
    """Attempts in order up to the ``cap``-th that was sent; later ones are not made."""
    place = F.struct(*order)
    first = tried.where(F.col("status") == "SENT").select(place.alias("_at")).orderBy("_at").limit(cap)
    last = first.agg(F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_n"))
    cut = last.select(F.when(F.col("_n") >= cap, F.col("_last"))).scalar()
    return tried.withColumn("_cut", cut).where(F.col("_cut").isNull() | (place <= F.col("_cut"))).drop("_cut")


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state needs the RocksDB store; a query takes the setting along when it starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def start(stream: DataFrame, monitor: Monitor, every: str = "60 seconds") -> StreamingQuery:
    """Run a cycle per trigger until stopped, new data or not: timers bring the backlog back."""
    with _state_store(stream.sparkSession):
        return monitor.writer(stream).trigger(processingTime=every).start()


def supervise(stream: DataFrame, monitor: Monitor, every: str = "60 seconds", restarts: int | None = None,
              pause: float = 1.0) -> int:
    """Keep the monitor running: a failed cycle is run again from the checkpoint.

    The wait before a restart starts at ``pause`` seconds and doubles up to a minute.

    Returns the restarts used once the query is stopped; raises the last error
    when ``restarts`` (None: no limit) are used up.
    """
    used = 0
    while True:
        query = start(stream, monitor, every)
        try:
            query.awaitTermination()
            return used
        except StreamingQueryException:
            if restarts is not None and used >= restarts:
                raise
            time.sleep(min(60.0, pause * 2 ** min(used, 10)))
            used += 1


def run_once(stream: DataFrame, monitor: Monitor) -> StreamingQuery:
    """One cycle over everything that is new, outcomes included; state carries over to the next."""
    with _state_store(stream.sparkSession):
        query = monitor.writer(stream).trigger(once=True).start()
    query.awaitTermination()
    return query
