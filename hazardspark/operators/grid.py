"""Two-level adaptive grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazardspark.functions.numeric import percent, rounded
from hazardspark.functions.tiers import micro_tier, susceptibility_tier
from hazardspark.operators.neighbours import idw
from hazardspark.operators.ordering import with_position
from hazardspark.operators.spatial import in_box, stack_layers
from hazardspark.params import Box, GridMeta, Refinement

RULE = Refinement()


def make_grid(spark: SparkSession, lat0: float, lon0: float, step: float, nlat: int, nlon: int) -> DataFrame:
    """All vertices of a regular grid, ``i, j`` in row-major order.

    Sizes are counts: a float range would gain or lose its end point.
    """
    return spark.range(nlat * nlon).select(
        F.expr(f"CAST(id DIV {nlon} AS INT)").alias("i"), (F.col("id") % nlon).cast("int").alias("j")
    ).select(
        "i", "j", (F.lit(lat0) + F.col("i") * F.lit(step)).alias("latitude"),
        (F.lit(lon0) + F.col("j") * F.lit(step)).alias("longitude"))


def terrestrial(df: DataFrame, elevation: str = "elevation") -> DataFrame:
    """Land cells: a known elevation above zero (nodata is negative or NULL)."""
    return df.where(F.col(elevation) > 0)


def cell_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Consecutive coarse ids over the remaining cells in row-major order."""
    numbered = with_position(df, order, "_no", start=1)
    return numbered.withColumn("cell_id", F.format_string("COARSE_C%05d", F.col("_no"))).drop("_no")


def needs_refinement(p: Column, slope: Column, rule: Refinement = RULE) -> Column:
    return (p >= rule.always) | ((p >= rule.steep) & (slope >= rule.slope))


def classify_cells(df: DataFrame, p: str = "p", slope: str = "slope", digits: int | None = 4) -> DataFrame:
    """Stored probability, static tier and refinement flag; both from the raw value."""
    return df.withColumns({
        "susceptibility_prob": rounded(F.col(p), digits),
        "risk_tier": susceptibility_tier(F.col(p)),
        "needs_refinement": F.coalesce(needs_refinement(F.col(p), F.col(slope)), F.lit(False)),
    })


def refinement_share(df: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("needs_refinement"))
    return df.agg(F.count(F.lit(1)).alias("cells"), flagged.alias("flagged"),
                  percent(flagged, F.count(F.lit(1))).alias("pct_flagged"))


def focal_parents(df: DataFrame, box: Box, p: str = "p", rule: Refinement = RULE) -> DataFrame:
    """Flagged cells in the box, or the global top flagged ones if the box has too few."""
    flagged = df.where("needs_refinement")
    inside = flagged.where(in_box(box))
    enough = inside.agg(F.count(F.lit(1))).scalar() >= F.lit(rule.min_parents)
    top = flagged.orderBy(F.desc(p), "cell_id").limit(rule.fallback_top)
    return inside.where(enough).unionByName(top.where(~enough))


def subdivide(parents: DataFrame, per_side: int = RULE.per_side, half_width: float = RULE.half_width) -> DataFrame:
    """Children of every parent cell, row-major from its south-west corner."""
    step = 2.0 * half_width / (per_side - 1)
    child = parents.select(
        F.col("cell_id").alias("parent_cell_id"), F.col("latitude").alias("parent_latitude"),
        F.col("longitude").alias("parent_longitude"), F.col("susceptibility_prob").alias("parent_susceptibility"),
        F.explode(F.sequence(F.lit(0), F.lit(per_side * per_side - 1))).alias("_k"))
    lat = F.col("parent_latitude") + (F.lit(-half_width) + F.floor(F.col("_k") / per_side) * F.lit(step))
    lon = F.col("parent_longitude") + (F.lit(-half_width) + (F.col("_k") % per_side) * F.lit(step))
    stem = F.substring_index("parent_cell_id", "_", -1)
    return child.select(
        F.format_string("FINE_%s_%03d", stem, F.col("_k") + 1).alias("fine_cell_id"),
        "parent_cell_id", "parent_latitude", "parent_longitude", "parent_susceptibility",
        F.bround(lat, 6).alias("latitude"), F.bround(lon, 6).alias("longitude"))


def refine(scored: DataFrame, p: str = "p", digits: int | None = 4) -> DataFrame:
    """Child score, its change against the stored parent score, and micro tier."""
    return scored.withColumns({
        "fine_susceptibility": rounded(F.col(p), digits),
        "risk_delta": rounded(F.col(p) - F.col("parent_susceptibility"), digits),
        "micro_risk_tier": micro_tier(F.col(p)),
    })


def resample(children: DataFrame, cells: DataFrame, meta: GridMeta, layers: dict[str, float | None],
             refs: DataFrame | None = None, interpolate: str | None = None, ref_id: str = "sl_no") -> DataFrame:
    """Features of child cells: every raster layer, and one inventory value by distance."""
    featured = stack_layers(children, cells, meta, layers)
    return featured if refs is None else idw(featured, refs, interpolate, ref_id)


def grid_summary(df: DataFrame, p: str, tier: str, tiers: tuple[str, ...], digits: int | None = 4) -> DataFrame:
    """Cell count, score statistics (population std) and tier counts in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("cells"), rounded(F.min(p), digits).alias("min_p"),
        rounded(F.max(p), digits).alias("max_p"), rounded(F.avg(p), digits).alias("mean_p"),
        rounded(F.stddev_pop(p), digits).alias("std_p"),
        *[F.count_if(F.col(tier) == t).alias(t.lower().replace(" ", "_")) for t in tiers])


def traceability(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphans, parents without children, and children per parent."""
    per_parent = children.groupBy(F.col("parent_cell_id").alias("cell_id")).agg(F.count(F.lit(1)).alias("_kids"))
    both = per_parent.join(parents.select("cell_id", F.lit(True).alias("_known")), "cell_id", "full")
    known = F.col("_known").isNotNull()
    return both.agg(
        F.coalesce(F.sum(F.when(~known, F.col("_kids"))), F.lit(0)).alias("orphans"),
        F.count_if(known & F.col("_kids").isNull()).alias("childless_parents"),
        F.min(F.when(known, F.col("_kids"))).alias("min_children"),
        F.max(F.when(known, F.col("_kids"))).alias("max_children"))
