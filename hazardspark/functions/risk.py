"""Rain trigger index and combined risk as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hazardspark.functions.numeric import clip01
from hazardspark.params import RainWeights, RiskWeights


def rain_index(r24: Column, r72: Column, r7d: Column, w: RainWeights = RainWeights()) -> Column:
    """Weighted sum of capped window ratios; NULL when any window is NULL."""
    return (
        F.lit(w.w24) * clip01(r24 / F.lit(w.t24))
        + F.lit(w.w72) * clip01(r72 / F.lit(w.t72))
        + F.lit(w.w7d) * clip01(r7d / F.lit(w.t7d))
    )


def risk_score(s: Column, index: Column, w: RiskWeights = RiskWeights()) -> Column:
    """Combined risk in [0, 1]; the static score alone where the index is NULL."""
    combined = F.lit(w.static) * s + F.lit(w.dynamic) * index + F.lit(w.interaction) * (s * index)
    return clip01(F.coalesce(combined, s))
