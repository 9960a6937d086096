"""Attribution of a linear model to its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardspark.functions.numeric import ratio
from hazardspark.operators.ordering import side_by_side, top_per_key

# fixed values: display names of model features
LABELS = {
    "num__elevation": "Elevation (m)",
    "num__slope": "Slope Gradient (°)",
    "num__aspect": "Aspect (°)",
    "num__curvature": "Profile Curvature",
    "num__soil_clay_0_5cm": "Soil Clay Content (g/kg)",
    "num__soil_sand_0_5cm": "Soil Sand Content (g/kg)",
    "num__soil_silt_0_5cm": "Soil Silt Content (g/kg)",
    "num__soil_bulk_density_0_5cm": "Soil Bulk Density (cg/cm³)",
    "cat__land_cover_10": "LULC: Tree Cover (10)",
    "cat__land_cover_30": "LULC: Grassland (30)",
    "cat__land_cover_50": "LULC: Built-up / Corridor (50)",
    "cat__land_cover_60": "LULC: Bare / Sparse Veg (60)",
    "cat__land_cover_70": "LULC: Snow / Ice (70)",
    "cat__land_cover_80": "LULC: Water Bodies (80)",
    "cat__land_cover_100": "LULC: Moss / Lichen (100)",
}
# fixed values: sentences of the risk inspector
NO_EXPLANATION = "Detailed local explanation unavailable for this location."
BEFORE = "Risk is elevated mainly because of the model's association with "
AFTER = " and terrain characteristics. Model-based explanation — not causal proof."


def background(train: DataFrame, features: list[str], n: int = 100, seed: int = 42, key: str = "id",
               order: Column | None = None) -> DataFrame:
    """Feature means of n rows drawn without replacement, as one row."""
    draw = F.xxhash64(F.lit(seed), F.col(key)) if order is None else order
    return train.orderBy(draw, key).limit(n).agg(*[F.avg(c).alias(c) for c in features])


def linear_attribution(df: DataFrame, coefficients: dict[str, float], means: DataFrame, key: str = "id") -> DataFrame:
    """Long table: one row per sample and feature with ``phi = w (x - mean)``."""
    centre = means.agg(F.struct(*[F.first(c).alias(c) for c in coefficients])).scalar()
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 (F.lit(float(w)) * (F.col(c) - F.col("_m")[c])).alias("phi"))
        for c, w in coefficients.items()])
    return df.withColumn("_m", centre).select(key, F.inline(rows))


def base_value(means: DataFrame, coefficients: dict[str, float], intercept: float) -> DataFrame:
    total = F.lit(float(intercept))
    for c, w in coefficients.items():
        total = total + F.lit(float(w)) * F.col(c)
    return means.select(total.alias("base"))


def global_ranking(phi: DataFrame) -> DataFrame:
    """Features by mean absolute phi, with their share of the largest in percent."""
    per = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    # one row per model feature from here on, so an unpartitioned window is small
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))
    top = F.max("mean_abs").over(Window.partitionBy())
    return ranked.select("rank", "feature", "mean_abs", ratio(F.col("mean_abs") * 100.0, top).alias("pct_of_top"))


def representative_row(df: DataFrame, name: str = "slide_name", key: str = "id") -> DataFrame:
    """A named positive above .90 with the highest score, else the highest positive."""
    known = F.col(name).isNotNull() & (F.lower(F.col(name)) != "nan")
    best = F.coalesce(known & (F.col("prob") > 0.90), F.lit(False))
    return df.where(F.col("label") == 1).orderBy(F.desc(best), F.desc("prob"), key).limit(1)


def local_top(phi: DataFrame, n: int = 8, key: str = "id") -> DataFrame:
    """The n largest contributions of each sample and their direction."""
    top = top_per_key(phi, [key], [F.desc(F.abs("phi")), F.asc("feature")], n, "rank")
    effect = F.when(F.col("phi") > 0, F.lit("increases_risk")).otherwise(F.lit("decreases_risk"))
    return top.withColumn("effect", effect)


def additivity_check(df: DataFrame, phi: DataFrame, base: DataFrame, coefficients: dict[str, float], intercept: float,
                     key: str = "id", own: str | None = None) -> DataFrame:
    """Largest gap between base + sum(phi) and the model's logit: column ``own``, which the
    model computed itself, or without it the logit of the coefficients."""
    logit = F.lit(float(intercept))
    for c, w in coefficients.items():
        logit = logit + F.lit(float(w)) * F.col(c)
    logit = logit if own is None else F.col(own)
    sums = phi.groupBy(key).agg(F.sum("phi").alias("_sum"))
    gap = F.abs(F.col("_sum") + F.col("_base") - F.col("_logit"))
    joined = df.select(key, logit.alias("_logit")).join(sums, key).withColumn("_base", base.scalar())
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.max(gap).alias("max_gap"))


def feature_labels(df: DataFrame, labels: dict[str, str] = LABELS, col: str = "feature") -> DataFrame:
    """Add ``label``: the display name, or the name itself."""
    lookup = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return df.withColumn("label", F.coalesce(F.try_element_at(lookup, F.col(col)), F.col(col)))


def explanation_text(ranking: DataFrame, n: int = 3, col: str = "feature") -> DataFrame:
    """One sentence from the top n features; a fixed one without a ranking."""
    top = ranking.where(F.col("rank") <= n)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", col))), lambda x: F.lower(x[col]))
    return top.agg(names.alias("_n")).select(
        F.when(F.size("_n") > 0, F.concat(F.lit(BEFORE), F.array_join("_n", ", "), F.lit(AFTER)))
        .otherwise(F.lit(NO_EXPLANATION)).alias("explanation"))


def summary(ranking: DataFrame, sample: DataFrame, top: DataFrame, model: str, disclaimer: str, key: str = "id") -> DataFrame:
    """One row of nested results: ranking and the representative sample."""
    listed = ranking.agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "mean_abs"))).alias("global_feature_ranking"))
    mine = top.join(sample.select(key), key, "left_semi").agg(
        F.array_sort(F.collect_list(F.struct("rank", "feature", "phi", "effect"))).alias("top_attributions"))
    best = sample.select(F.struct(*sample.columns).alias("sample"))
    return side_by_side(listed, mine, best).select(
        F.lit(model).alias("model_used"), "global_feature_ranking",
        F.struct("sample", "top_attributions").alias("representative_high_risk_sample"),
        F.lit(disclaimer).alias("scientific_disclaimer"))
