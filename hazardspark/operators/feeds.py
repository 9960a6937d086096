"""The queries a reader of the result tables asks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazardspark.operators.forecast import grid_forecast_long
from hazardspark.operators.ordering import with_position


def every_nth(df: DataFrame, n: int, order: list[str], position: str | None = None) -> DataFrame:
    """Rows 0, n, 2n, ... of the given order."""
    name = position or "_pos"
    numbered = with_position(df, order, name)
    kept = numbered.where(F.col(name) % n == 0)
    return kept if position else kept.drop(name)


def q_coarse(df: DataFrame, order: list[str], sample_step: int | None = None, limit: int | None = None,
             tier: str | None = None, district: str | None = None, column: str = "risk_tier",
             filter_first: bool = False) -> DataFrame:
    """Coarse cells: sampled, limited, then filtered, in this order.

    ``filter_first=True`` filters before sampling. A filter on a column the
    table does not have matches nothing.
    """
    def filtered(rows: DataFrame) -> DataFrame:
        for col, wanted in ((column, tier), ("district", district)):
            if wanted is None:
                continue
            match = F.lower(F.col(col)) == wanted.lower() if col in rows.columns else F.lit(False)
            rows = rows.where(match)
        return rows

    if filter_first:
        df = filtered(df)
    if sample_step is not None and sample_step > 1:
        df = every_nth(df, sample_step, order)
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    return df if filter_first else filtered(df)


def q_fine(df: DataFrame, order: list[str], limit: int | None = 500) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def horizon_candidates(text: str) -> list[str]:
    """Spellings to try: as given, trimmed, with and without the leading plus."""
    bare = text.strip().lstrip("+").strip()
    return list(dict.fromkeys([text, text.strip(), "+" + bare, bare]))


def normalize_horizon(col: Column) -> Column:
    """Canonical ``+24h`` form; a plus that arrived as a space is restored."""
    return F.concat(F.lit("+"), F.trim(F.regexp_replace(F.trim(col), r"^\++", "")))


def available_horizons(df: DataFrame) -> list[str]:
    """Horizons named by the columns of a wide table."""
    return [c[len("risk_"):] for c in df.columns if c.startswith("risk_") and f"ridx_{c[len('risk_'):]}" in df.columns]


def distinct_horizons(df: DataFrame) -> DataFrame:
    """Horizons of a long table."""
    return df.select("forecast_horizon").distinct()


def q_forecast(df: DataFrame, order: list[str], horizon: str | None = None, sample_step: int | None = None,
               limit: int | None = None) -> DataFrame:
    """Grid forecast for one horizon from a long or wide table.

    The horizon may be spelled in any known way; one that the table lacks is an
    error. For a long table that takes a look at the data.
    """
    if sample_step is not None and sample_step > 1:
        df = every_nth(df, sample_step, order)
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    if horizon is None:
        return df
    if "forecast_horizon" in df.columns:
        for name in horizon_candidates(horizon):
            rows = df.where(F.col("forecast_horizon") == name)
            if not rows.isEmpty():
                return rows
        raise ValueError(f"horizon {horizon!r} not available")
    have = available_horizons(df)
    for name in horizon_candidates(horizon):
        if name in have:
            return grid_forecast_long(df, name)
    raise ValueError(f"horizon {horizon!r} not available, have {have}")


def q_hotspots(df: DataFrame) -> DataFrame:
    return df


def q_alerts(feed: DataFrame, severity: str | None = None) -> DataFrame:
    return feed if severity is None else feed.where(F.col("alert_severity") == severity)


def q_attribution(spark: SparkSession, path: str) -> DataFrame:
    """Projection of a stored attribution summary, or one error row."""
    try:
        stored = spark.read.json(path)
    except AnalysisException as error:
        return spark.range(1).select(F.lit(error.getCondition() or "unreadable").alias("error"),
                                     F.lit("attribution data not available").alias("status"))
    return stored.select(
        F.col("model_used").alias("model"), F.col("global_feature_ranking").alias("global_features"),
        F.col("representative_high_risk_sample").alias("representative_sample"), "scientific_disclaimer")


def monitor_status(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("dispatched_keys_count"))
