"""Temporal catalogue of dated events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazardspark.functions import dates


def with_event_date(df: DataFrame, col: str = "history", range_end: bool = True,
                    cutoff_year: int | None = None) -> DataFrame:
    """Add ``event_date``; dates after the cut-off year are not trusted."""
    date = dates.event_date(F.col(col), range_end)
    if cutoff_year is not None:
        date = F.when(F.year(date) <= cutoff_year, date)
    return df.withColumn("event_date", date)


def classify_dates(df: DataFrame, col: str = "history", cutoff_year: int = 2024) -> DataFrame:
    dated = df.withColumn("event_date", dates.audit_date(F.col(col)))
    return dated.withColumn("status", dates.date_status(F.col(col), F.col("event_date"), cutoff_year))


def events_per_date(df: DataFrame) -> DataFrame:
    return df.where(F.col("event_date").isNotNull()).groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


def date_span(df: DataFrame) -> DataFrame:
    per_date = events_per_date(df)
    return per_date.agg(
        F.count(F.lit(1)).alias("distinct_dates"), F.sum("events").alias("dated_events"),
        F.min("event_date").alias("earliest"), F.max("event_date").alias("latest"))


def required_months(df: DataFrame, lookback: int = 6) -> DataFrame:
    """Every (year, month) an event or its lookback touches."""
    days = df.where(F.col("event_date").isNotNull()).select("event_date").distinct()
    touched = F.explode(F.sequence(F.date_sub("event_date", lookback), F.col("event_date")))
    d = days.select(touched.alias("d"))
    return d.select(F.year("d").alias("year"), F.month("d").alias("month")).distinct()


def reconcile_sets(required: DataFrame, manifest: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Presence flags of every key over three sets, from one shuffle."""
    tagged = None
    for i, df in enumerate((required, manifest, actual)):
        part = df.select(*keys, *[F.lit(i == j).alias(n) for j, n in enumerate(
            ("in_required", "in_manifest", "in_actual"))])
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(*keys).agg(
        *[F.bool_or(n).alias(n) for n in ("in_required", "in_manifest", "in_actual")])


def reconcile_summary(flags: DataFrame) -> DataFrame:
    r, m, a = F.col("in_required"), F.col("in_manifest"), F.col("in_actual")
    return flags.agg(
        F.count_if(r & ~a).alias("missing"), F.count_if(a & ~r).alias("unexpected"),
        F.bool_and(r & m & a).alias("all_equal"))


def parse_file_names(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Matched flag plus year and month (capture groups 1 and 2)."""
    name = F.col(col)
    hit = F.coalesce(name.rlike(pattern), F.lit(False))

    def number(group: int):
        return F.when(hit, F.regexp_extract(name, pattern, group).try_cast("int"))

    return df.select("*", hit.alias("matched"), number(1).alias("year"), number(2).alias("month"))
