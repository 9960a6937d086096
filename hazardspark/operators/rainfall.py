"""Antecedent rainfall windows and their audits.

A daily table has one row per cell and day: ``cell_id, d, precip``. A missing
day is an absent row or a NULL value; it is never read as zero unless the caller
asks for that policy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

EPOCH = "1970-01-01"
WINDOW_DAYS = {"r24": 1, "r72": 3, "r7d": 7}


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(EPOCH).cast("date"))


def negative_policy(df: DataFrame, col: str = "precip", mode: str = "null") -> DataFrame:
    """Missing or negative depth -> NULL (default) or 0 (``mode='zero'``)."""
    value = F.col(col)
    if mode == "null":
        return df.withColumn(col, F.when(value >= 0, value))
    if mode == "zero":
        return df.withColumn(col, F.when(value >= 0, value).otherwise(F.lit(0.0)))
    raise ValueError(f"unknown mode {mode!r}")


def _guarded(sums: dict[str, Column], counts: dict[str, Column], complete: str) -> dict[str, Column]:
    """Windows with a missing day become NULL: each on its own, or all together."""
    if complete == "each":
        return {k: F.when(counts[k] == n, sums[k]) for k, n in WINDOW_DAYS.items()}
    if complete == "all":
        return {k: F.when(counts["r7d"] == 7, sums[k]) for k in WINDOW_DAYS}
    if complete == "none":
        return dict(sums)
    raise ValueError(f"unknown completeness rule {complete!r}")


def rolling_windows(daily: DataFrame, complete: str = "each", span: int = 56) -> DataFrame:
    """24 h / 72 h / 7 d sums for every cell and day.

    Days are cut into spans and each span also receives the six days before it,
    so a window task holds at most ``span + 6`` days of one cell however long
    the record of a cell is. One shuffle, about ``6 / span`` extra rows.
    """
    number = F.col("_day")
    own = F.floor(number / span).cast("int")
    needed = F.sequence(own, F.floor((number + 6) / span).cast("int"))
    spread = daily.withColumn("_day", day_number(F.col("d"))).withColumn("_span", F.explode(needed))
    base = Window.partitionBy("cell_id", "_span").orderBy("_day")
    sums, counts = {}, {}
    for key, days in WINDOW_DAYS.items():
        frame = base.rangeBetween(-(days - 1), 0)
        sums[key] = F.sum("precip").over(frame)
        counts[key] = F.count("precip").over(frame)
    wide = spread.select(
        "cell_id", "d", "_day", "_span",
        *[c.alias(f"_s_{k}") for k, c in sums.items()],
        *[c.alias(f"_c_{k}") for k, c in counts.items()],
    ).where(F.col("_span") == own)
    guarded = _guarded(
        {k: F.col(f"_s_{k}") for k in WINDOW_DAYS}, {k: F.col(f"_c_{k}") for k in WINDOW_DAYS}, complete
    )
    return wide.select("cell_id", "d", *[c.alias(k) for k, c in guarded.items()])


def _lagged(keys: DataFrame, date_col: str) -> DataFrame:
    """Seven rows per key row, one per day of its lookback."""
    lag = keys.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return lag.withColumn("d", F.date_sub(F.col(date_col), F.col("lag")))


def _sums_by_lag(complete: str) -> dict[str, Column]:
    sums = {k: F.sum(F.when(F.col("lag") < n, F.col("precip"))) for k, n in WINDOW_DAYS.items()}
    counts = {k: F.count(F.when(F.col("lag") < n, F.col("precip"))) for k, n in WINDOW_DAYS.items()}
    return _guarded(sums, counts, complete)


def antecedent_at(events: DataFrame, daily: DataFrame, complete: str = "each") -> DataFrame:
    """Windows ending on the event date at the event's cell.

    ``events`` needs ``cell_id`` and ``event_date``; every other column is kept.
    The lags are built once per distinct cell and date, so many events on one
    cell and date cost one lookback.
    """
    wanted = events.select("cell_id", "event_date").where(F.col("event_date").isNotNull()).distinct()
    found = (
        _lagged(wanted, "event_date")
        .join(daily.select("cell_id", "d", "precip"), ["cell_id", "d"], "left")
        .groupBy("cell_id", "event_date")
        .agg(*[c.alias(k) for k, c in _sums_by_lag(complete).items()])
    )
    return events.join(found, ["cell_id", "event_date"], "left")


def antecedent_grid(daily: DataFrame, date: Column | str, complete: str = "each") -> DataFrame:
    """Windows of all cells at one date; only its seven days are read."""
    end = F.lit(date).cast("date") if isinstance(date, str) else date
    days = daily.where(F.col("d").between(F.date_sub(end, 6), end))
    lagged = days.withColumn("lag", F.datediff(end, F.col("d")))
    return lagged.groupBy("cell_id").agg(*[c.alias(k) for k, c in _sums_by_lag(complete).items()])


def lookback_coverage(events: DataFrame, available: DataFrame) -> DataFrame:
    """Per event date: events, days present and the missing days of the lookback."""
    per_date = events.where(F.col("event_date").isNotNull()).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("events")
    )
    have = available.select("d").distinct().withColumn("_have", F.lit(True))
    return (
        _lagged(per_date, "event_date")
        .join(have, "d", "left")
        .groupBy("event_date", "events")
        .agg(
            F.count("_have").alias("days_present"),
            F.array_sort(F.collect_list(F.when(F.col("_have").isNull(), F.col("d")))).alias("missing_days"),
        )
        .withColumn("complete", F.col("days_present") == 7)
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    missing = F.when(~F.col("complete"), F.col("events"))
    return coverage.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("dated_events"),
        F.count(F.lit(1)).alias("distinct_dates"),
        F.coalesce(F.sum(F.when(F.col("complete"), F.col("events"))), F.lit(0)).alias("complete_events"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("incomplete_events"),
    )


def missing_dates(coverage: DataFrame) -> DataFrame:
    """Missing days with the number of event lookbacks that need them."""
    return (
        coverage.select("events", F.explode("missing_days").alias("d"))
        .groupBy("d")
        .agg(F.sum("events").alias("needed_by"))
    )


def accumulation_checks(df: DataFrame, tol: float = 0.0, dated: str = "event_date") -> DataFrame:
    """Violation counts over dated rows: negatives, shrinking windows, gaps."""
    rows = df.where(F.col(dated).isNotNull())
    negatives = reduce(lambda a, b: a + b, [F.count_if(F.col(c) < 0) for c in WINDOW_DAYS])
    gaps = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in WINDOW_DAYS])
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        negatives.alias("negative_values"),
        F.count_if(F.col("r72") < F.col("r24") - F.lit(tol)).alias("r72_below_r24"),
        F.count_if(F.col("r7d") < F.col("r72") - F.lit(tol)).alias("r7d_below_r72"),
        gaps.alias("missing_values"),
        F.count_if(F.dayofmonth(dated) <= 6).alias("month_boundary_rows"),
    )


def reconcile(
    stored: DataFrame,
    recomputed: DataFrame,
    key: str,
    cols: list[str],
    tol: float = 1e-3,
    only_date: Column | None = None,
) -> DataFrame:
    """Largest absolute difference per feature and whether all are within ``tol``.

    A value missing on one side only counts as a mismatch.
    """
    if only_date is not None:
        stored = stored.where(only_date)
    right = recomputed.select(key, *[F.col(c).alias(f"_re_{c}") for c in cols])
    joined = stored.join(right, key)
    aggs, oks = [], []
    for c in cols:
        diff = F.abs(F.col(c) - F.col(f"_re_{c}"))
        one_sided = F.col(c).isNull() != F.col(f"_re_{c}").isNull()
        ok = F.coalesce(diff <= F.lit(tol), ~one_sided)
        aggs.append(F.max(diff).alias(f"max_diff_{c}"))
        aggs.append(F.count_if(~ok).alias(f"mismatch_{c}"))
        oks.append(F.col(f"mismatch_{c}") == 0)
    out = joined.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    return out.withColumn("all_ok", reduce(lambda a, b: a & b, oks))


def month_boundary_audit(events: DataFrame, daily: DataFrame, key: str, tol: float = 1e-3) -> DataFrame:
    """Recheck stored windows of events on days 1-6, whose lookback crosses a month.

    ``events`` carries the stored ``r24, r72, r7d``. Lookbacks are built per
    distinct cell and date and then compared with every event.
    """
    edge = events.where(F.dayofmonth("event_date") <= 6)
    wanted = edge.select("cell_id", "event_date").distinct()
    day = F.struct(F.col("d"), F.col("precip").alias("v"))
    found = (
        _lagged(wanted, "event_date")
        .join(daily.select("cell_id", "d", "precip"), ["cell_id", "d"], "left")
        .groupBy("cell_id", "event_date")
        .agg(
            F.array_sort(F.collect_list(day)).alias("_days"),
            *[c.alias(f"calc_{k}") for k, c in _sums_by_lag("each").items()],
        )
        .select(
            "cell_id",
            "event_date",
            F.transform("_days", lambda x: F.date_format(x["d"], "yyyy-MM")).alias("_months"),
            F.transform("_days", lambda x: x["v"]).alias("daily_values"),
            *[f"calc_{k}" for k in WINDOW_DAYS],
        )
        .withColumn("months_used", F.array_join(F.array_distinct("_months"), ","))
        .drop("_months")
    )
    ok = reduce(
        lambda a, b: a & b,
        [
            F.coalesce(F.abs(F.col(k) - F.col(f"calc_{k}")) < F.lit(tol),
                       F.col(k).isNull() & F.col(f"calc_{k}").isNull())
            for k in WINDOW_DAYS
        ],
    )
    return edge.join(found, ["cell_id", "event_date"]).withColumn("is_correct", ok)


def grid_axis_check(df: DataFrame, file: str, axes: list[str], day: str = "d") -> DataFrame:
    """Per file: axis length, extent, mean absolute step, and date span.

    The mean step of a sorted distinct axis telescopes to
    ``(max - min) / (n - 1)``, so no ordering is needed.
    """
    aggs = []
    for a in axes:
        n = F.countDistinct(a)
        lo, hi = F.min(a).cast("double"), F.max(a).cast("double")
        aggs += [
            n.alias(f"{a}_len"),
            lo.alias(f"{a}_min"),
            hi.alias(f"{a}_max"),
            F.try_divide(hi - lo, (n - 1).cast("double")).alias(f"{a}_step"),
        ]
    return df.groupBy(file).agg(
        *aggs, F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.countDistinct(day).alias("days"),
    )


def verdict(checks: DataFrame) -> DataFrame:
    """PASS / PARTIAL / FAIL of a one-row checks table, later rules override.

    Needs ``unreadable_files, points_outside, missing_files, incomplete_events``.
    """
    rules = [
        ("unreadable_files", "FAIL", "files could not be read"),
        ("points_outside", "FAIL", "points outside the grid"),
        ("missing_files", "PARTIAL", "expected files missing"),
        ("incomplete_events", "PARTIAL", "events without a complete lookback"),
    ]
    status, reasons = F.lit("PASS"), []
    for col, result, text in rules:
        hit = F.col(col) > 0
        status = F.when(hit, F.lit(result)).otherwise(status)
        reasons.append(F.when(hit, F.concat(F.col(col).cast("string"), F.lit(f" {text}"))))
    listed = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    return checks.select(
        "*", status.alias("status"),
        F.when(F.length(listed) > 0, listed).otherwise(F.lit("all checks passed")).alias("reasons"),
    )


def verified(checks: DataFrame, flags: list[str]) -> DataFrame:
    """VERIFIED only if every flag holds."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(f), F.lit(False)) for f in flags])
    text = F.when(ok, F.lit("VERIFIED")).otherwise(F.lit("DATA EXTRACTION ISSUE"))
    return checks.withColumn("decision", text)
