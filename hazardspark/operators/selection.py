"""Exact quantiles by distributed selection.

A quantile is narrowed in rounds: the open range is cut into cells, each cell is counted
with its least and greatest value, and the cell that holds the rank is the next range.
Tasks send counts of cells, never values, and the driver sees at most ``CELLS`` rows per
open rank and round. Ranges shrink to the values they hold, so a far outlier costs a round
and not the resolution.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

CELLS = 1024


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """Values at the given places (from 0) of the sorted numbers of ``column``; NULL and NaN are left out."""
    v = F.col("_v")
    rows = df.select(F.col(column).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    count, low, high = rows.agg(F.count(v), F.min(v), F.max(v)).first()
    if any(not 0 <= r < count for r in ranks):
        raise ValueError(f"ranks must lie between 0 and {count - 1}")
    open_ranges = {r: (low, high, 0) for r in ranks}  # least and greatest value, numbers before them
    while True:
        wide = sorted({(a, b) for a, b, _ in open_ranges.values() if a < b})
        if not wide:
            return [open_ranges[r][0] for r in ranks]
        cells = []
        for k, (a, b) in enumerate(wide):
            # halves, since the difference of two doubles may not be finite
            share = (v / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2 or math.ulp(0.0))
            cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1))
            cells.append(F.when((v >= a) & (v <= b), F.struct(F.lit(k).alias("k"), cell.alias("cell"))))
        found = rows.select("_v", F.explode(F.array_compact(F.array(*cells))).alias("at")).groupBy("at").agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
        parts = {k: sorted((r["at"]["cell"], r["n"], r["low"], r["high"]) for r in found if r["at"]["k"] == k) for k in range(len(wide))}
        for rank, (a, b, before) in open_ranges.items():
            if a == b:
                continue
            for _, n, cell_low, cell_high in parts[wide.index((a, b))]:
                if rank < before + n:
                    open_ranges[rank] = (cell_low, cell_high, before)
                    break
                before += n


def quantile(df: DataFrame, column: str, share: float = 0.5) -> float | None:
    """Quantile with linear interpolation between neighbours; None without numbers."""
    v = F.col(column).cast("double")
    count = df.where(v.isNotNull() & ~F.isnan(v)).count()
    if not count:
        return None
    place = share * (count - 1)
    low, high = order_statistics(df, column, [math.floor(place), math.ceil(place)])
    return low + (high - low) * (place - math.floor(place))
