"""Training set: positives, background negatives, checks, and spatial splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardspark.operators.neighbours import (
    cross_duplicates, distance_stats, exclude_within, idw, nearest_distance, nearest_label, thin_by_spacing)
from hazardspark.operators.ordering import side_by_side, with_position
from hazardspark.operators.spatial import local_metres


def positives(inventory: DataFrame, rain: DataFrame, soil: DataFrame, layers: DataFrame, key: str = "sl_no") -> DataFrame:
    """Inventory rows with rain, soil and sampled layers, joined on the key."""
    joined = inventory.join(rain, key, "left").join(soil, key, "left").join(layers, key, "left")
    dated = F.col("r24").isNotNull()
    return joined.select(
        F.concat(F.lit("LS_"), F.col(key).cast("string")).alias("sample_id"), F.lit(1).alias("label"),
        F.when(dated, F.lit("dated_event_positive")).otherwise(F.lit("baseline_inventory_positive")).alias("sample_type"),
        dated.alias("is_dated"), *[c for c in joined.columns if c not in ("label",)])


def negatives(candidates: DataFrame, inventory: DataFrame, count: int | None = None, buffer: float = 1000.0, spacing: float = 800.0,
              ref_id: str = "sl_no", interpolate: str | None = None, district: str = "district") -> DataFrame:
    """Background samples: far from every positive, spaced among themselves, in rank order.

    ``candidates`` carries ``r, c, latitude, longitude, rank`` and its sampled
    layers; without ``count`` there are as many as inventory rows. The district comes from the nearest inventory point and the
    ``interpolate`` column from its five nearest.
    """
    count = inventory.count() if count is None else count
    cell = candidates.withColumn("_cell", F.struct("r", "c"))
    far = exclude_within(local_metres(cell), local_metres(inventory), buffer, ref_id)
    spaced = thin_by_spacing(far, spacing, "rank", "_cell", limit=count)
    placed = nearest_label(spaced, inventory, district, ref_id)
    if interpolate is not None:
        placed = idw(placed, inventory, interpolate, ref_id)
    numbered = with_position(placed, ["rank", "r", "c"], "_no", start=1)
    return numbered.select(
        F.format_string("BG_%04d", "_no").alias("sample_id"), F.lit(0).alias("label"),
        F.lit("background_negative").alias("sample_type"), F.lit(False).alias("is_dated"),
        *[c for c in numbered.columns if c not in ("_no", "_cell", "rank", "r", "c", "x", "y")])


def ml_dataset(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Both classes by column name; what negatives lack is NULL."""
    return pos.unionByName(neg, allowMissingColumns=True)


def ml_qa(data: DataFrame, buffer: float = 1000.0) -> DataFrame:
    """Class and dated counts, repeated coordinates, and distance to positives."""
    at = ["latitude", "longitude"]
    pos, neg = data.where(F.col("label") == 1), data.where(F.col("label") == 0)
    counts = data.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"), F.count_if("is_dated").alias("dated"))
    spots = data.groupBy("label", *at).agg((F.count(F.lit(1)) - 1).alias("_n")).agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("_n"))), F.lit(0)).alias("positive_duplicates"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("_n"))), F.lit(0)).alias("negative_duplicates"))
    cross = cross_duplicates(pos, neg, at).select(F.col("pairs").alias("cross_duplicates"))
    gaps = distance_stats(nearest_distance(local_metres(neg), local_metres(pos), "sample_id"), buffer).select(
        F.col("min_distance").alias("min_buffer_m"), F.col("below").alias("leakage_violations"))
    return side_by_side(counts, spots, cross, gaps)


def spatial_blocks(df: DataFrame, n: int = 5, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Block key ``i_j`` of equal-width, right-closed bins per axis."""
    eps = 1e-5
    bounds = df.agg(F.struct(
        (F.min(lat) - eps).alias("la"), (F.max(lat) + eps).alias("lz"),
        (F.min(lon) - eps).alias("oa"), (F.max(lon) + eps).alias("oz"))).scalar()

    def bin_of(c: str, lo: str, hi: str) -> Column:
        width = (F.col("_b")[hi] - F.col("_b")[lo]) / F.lit(float(n))
        raw = F.ceil((F.col(c) - F.col("_b")[lo]) / width) - 1
        return F.greatest(F.least(raw, F.lit(n - 1)), F.lit(0)).cast("string")

    out = df.withColumn("_b", bounds)
    return out.withColumn("spatial_block", F.concat_ws("_", bin_of(lat, "la", "lz"), bin_of(lon, "oa", "oz"))).drop("_b")


def group_holdout(df: DataFrame, group: str, frac: float = 0.2, seed: int = 42, shuffle: Column | None = None) -> DataFrame:
    """Add ``is_test``: whole groups, ceil(frac * groups) of them in shuffled order."""
    order = F.xxhash64(F.lit(seed), F.col(group).cast("string")) if shuffle is None else shuffle
    groups = df.select(group).distinct().withColumn("_h", order)
    placed = with_position(groups, ["_h", group], "_pos")
    n_test = groups.agg(F.ceil(F.count(F.lit(1)) * F.lit(frac))).scalar()
    chosen = placed.withColumn("is_test", F.col("_pos") < n_test).select(group, "is_test")
    return df.join(chosen, group)


def buffered_train(df: DataFrame, key: str, metres: float = 500.0) -> DataFrame:
    """Drop training rows closer than ``metres`` to any test row (needs ``x, y, is_test``)."""
    test = df.where("is_test")
    train = exclude_within(df.where(~F.col("is_test")), test, metres, key)
    return train.unionByName(test)


_DEAL = 1 << 16  # groups dealt to a fold by one row of the plan


def _shares(loads: list[int], weight: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each fold gets when each goes to the lightest
    fold (the first of equals)."""

    def dealt(level: int) -> list[int]:
        """Groups that start a fold's load at ``level`` or lower."""
        return [max(0, (level - load) // weight + 1) for load in loads]

    low, high = min(loads) - 1, max(loads) + weight * count
    while high - low > 1:  # the highest level at which not all groups are dealt
        middle = (low + high) // 2
        low, high = (middle, high) if sum(dealt(middle)) < count else (low, middle)
    out = dealt(low)
    for fold, load in enumerate(loads):
        if sum(out) < count and load <= low + 1 and (low + 1 - load) % weight == 0:
            out[fold] += 1
    return out


def _turn(fold: Column, j: Column, weight: Column, loads: Column) -> Column:
    """Place, among the groups of one size, of the ``j``-th group that a fold gets: all
    groups of other folds that start at a lower load, or at an equal one in an earlier fold."""
    level = F.element_at(loads, fold + 1) + j * weight

    def before(load: Column, other: Column) -> Column:
        gap = level - load
        equal = F.when((gap % weight == 0) & (other < fold), F.lit(1)).otherwise(F.lit(0))
        below = F.when(gap > 0, F.floor((gap - 1) / weight) + 1).otherwise(F.lit(0))
        return F.when(other == fold, j).when(gap < 0, F.lit(0)).otherwise(below + equal).cast("long")

    return F.aggregate(F.transform(loads, before), F.lit(0).cast("long"), lambda s, v: s + v)


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Add ``fold``: groups by falling size (then by key), each to the lightest fold so far.

    Groups of one size are dealt as one step: how many each fold gets follows from the
    loads before. So the driver sees one row per distinct size (at most about the square
    root of twice the rows), and the groups are numbered in ranges and joined by place.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_position(sizes, [F.desc("_n"), F.col(group)], "_at")
    classes = sorted(((r["_n"], r["m"]) for r in placed.groupBy("_n").agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    loads, start, plan = [0] * k, 0, []
    for weight, count in classes:
        shares = _shares(loads, weight, count)
        plan += [(start, weight, fold, share, list(loads)) for fold, share in enumerate(shares) if share]
        loads = [load + share * weight for load, share in zip(loads, shares)]
        start += count
    steps = df.sparkSession.createDataFrame(plan, "start long, weight long, fold int, share long, loads array<long>")
    dealt = steps.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("share") - 1) / _DEAL))))
    first = F.col("_piece") * _DEAL
    dealt = dealt.repartition("start", "fold", "_piece").withColumn(
        "j", F.explode(F.sequence(first, F.least(first + (_DEAL - 1), F.col("share") - 1))))
    turn = _turn(F.col("fold"), F.col("j"), F.col("weight"), F.col("loads"))
    folds = dealt.select((F.col("start") + turn).alias("_at"), "fold")
    return df.join(placed.join(folds, "_at").select(group, "fold"), group)
