"""Tier scales. Three scales share names, so each function names its scale."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hazardspark import params


def _ladder(value: Column, steps: tuple, below: str, missing: str | None) -> Column:
    out = F.when(value.isNull(), F.lit(missing))
    for name, edge in steps:
        out = out.when(value >= F.lit(edge), F.lit(name))
    return out.otherwise(F.lit(below))


def risk_tier(value: Column) -> Column:
    return _ladder(value, params.RISK_TIERS, "Low", "Unknown")


def susceptibility_tier(value: Column) -> Column:
    return _ladder(value, params.SUSCEPTIBILITY_TIERS, "Low", None)


def micro_tier(value: Column) -> Column:
    return _ladder(value, params.MICRO_TIERS, "Low", None)


def alert_severity(risk: Column) -> Column:
    """HIGH / VERY HIGH, NULL below the alert floor or without a risk."""
    return (
        F.when(risk >= F.lit(params.ALERT_VERY_HIGH), F.lit("VERY HIGH"))
        .when(risk >= F.lit(params.ALERT_FLOOR), F.lit("HIGH"))
    )


def tier_bucket(tier: Column) -> Column:
    """Four display buckets by substring; anything else counts as LOW."""
    text = F.upper(F.coalesce(tier, F.lit("")))
    return (
        F.when(text.contains("VERY"), F.lit("VERY HIGH"))
        .when(text.contains("HIGH"), F.lit("HIGH"))
        .when(text.contains("MODERATE"), F.lit("MODERATE"))
        .otherwise(F.lit("LOW"))
    )
