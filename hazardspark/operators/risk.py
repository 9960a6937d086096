"""Dynamic risk of grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardspark import params
from hazardspark.functions.numeric import percent, rounded
from hazardspark.functions.risk import rain_index, risk_score
from hazardspark.functions.tiers import risk_tier
from hazardspark.operators.rainfall import antecedent_grid


def score_cells(df: DataFrame, s: str = "s", mm_digits: int | None = 2,
                score_digits: int | None = 4) -> DataFrame:
    """Index, risk, tier and availability tags from ``r24, r72, r7d`` and ``s``.

    The tier comes from the unrounded score; rounding is for storage.
    """
    index = rain_index(F.col("r24"), F.col("r72"), F.col("r7d"))
    scored = df.withColumn("_index", index)
    scored = scored.withColumn("_risk", risk_score(F.col(s), F.col("_index")))
    dry = F.col("_index").isNull()
    return scored.select(
        *[c for c in df.columns if c not in ("r24", "r72", "r7d")],
        rounded(F.col("r24"), mm_digits).alias("rainfall_24h"),
        rounded(F.col("r72"), mm_digits).alias("rainfall_72h"),
        rounded(F.col("r7d"), mm_digits).alias("rainfall_7d"),
        rounded(F.col("_index"), score_digits).alias("rainfall_trigger_index"),
        rounded(F.col(s), score_digits).alias("susceptibility_score"),
        rounded(F.col("_risk"), score_digits).alias("risk_score"),
        risk_tier(F.col("_risk")).alias("risk_category"),
        F.when(dry, F.lit("static_baseline_only")).otherwise(F.lit("dynamic_composite")).alias("risk_mode"),
        F.when(dry, F.lit("unavailable")).otherwise(F.lit("available")).alias("rainfall_status"),
    )


def enrich_risk(grid: DataFrame, daily: DataFrame, date: Column | str, s: str = "s",
                mm_digits: int | None = 2, score_digits: int | None = 4) -> DataFrame:
    """Rainfall of one date joined to the grid by cell, then scored."""
    rain = antecedent_grid(daily, date)
    return score_cells(grid.join(rain, "cell_id", "left"), s, mm_digits, score_digits)


def tier_counts(df: DataFrame, tier: str) -> DataFrame:
    """Count and share of every tier in display order, zero tiers included."""
    total = F.count(F.lit(1))
    rows = F.array(*[
        F.struct(F.lit(i).alias("tier_order"), F.lit(t).alias("tier"),
                 F.count_if(F.col(tier) == t).alias("cells"),
                 percent(F.count_if(F.col(tier) == t), total).alias("pct"))
        for i, t in enumerate(params.TIER_ORDER)
    ])
    return df.agg(rows.alias("_rows")).select(F.inline("_rows"))


def score_summary(df: DataFrame, cols: list[str], digits: int | None = 4) -> DataFrame:
    """Mean, min and max per score column, one row per column."""
    long = df.select(*cols).unpivot([], cols, "measure", "value") if len(cols) > 1 else df.select(
        F.lit(cols[0]).alias("measure"), F.col(cols[0]).alias("value"))
    return long.groupBy("measure").agg(
        F.count("value").alias("n"),
        rounded(F.avg("value"), digits).alias("mean"),
        rounded(F.min("value"), digits).alias("min"),
        rounded(F.max("value"), digits).alias("max"),
    )
