"""Nearest neighbours and spacing in a plane, without all-pairs joins.

``nearest`` walks down a pyramid of square tiles (each level four times finer).
Per query point it keeps only the tiles that can still hold one of the ``k``
nearest reference points, judged by tile counts and distances to tile corners,
and looks at single points once few enough are left. A crowded tile is therefore
split before its points are paired with anything, and the result is exact.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardspark.functions.numeric import planar_distance
from hazardspark.operators.ordering import top_per_key, with_position
from hazardspark.operators.selection import quantile
from hazardspark.session import discard, materialize

_FANOUT_BITS = 2  # a tile has 4 x 4 children
_MAX_LEVEL = 12
_BROADCAST_LEVEL = 3  # at most 16**3 tiles up to here, small whatever the data
_SLACK = 1.0 + 1e-9


def _tile(v: Column, origin: float, edge: float) -> Column:
    return F.floor((v - F.lit(origin)) / F.lit(edge))


def _up(tile: Column, levels: int) -> Column:
    """Tile index ``levels`` higher up the pyramid."""
    return F.shiftright(tile, _FANOUT_BITS * levels)


def _gap(v: Column, lo: Column, hi: Column) -> Column:
    """Distance from a coordinate to an interval."""
    return F.greatest(lo - v, v - hi, F.lit(0.0))


def _reach(v: Column, lo: Column, hi: Column) -> Column:
    """Largest distance from a coordinate to an interval."""
    return F.greatest(F.abs(v - lo), F.abs(v - hi))


def _placed(c: str) -> Column:
    """True for a finite coordinate; NULL, NaN and infinity have no place."""
    return F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(float("inf")))


def _max_occupancy(points: DataFrame, x0: float, y0: float, edge: float) -> int:
    counts = points.groupBy(_tile(F.col("rx"), x0, edge), _tile(F.col("ry"), y0, edge)).count()
    return counts.agg(F.max("count")).first()[0]


def nearest(queries: DataFrame, refs: DataFrame, ref_id: str, k: int = 1, x: str = "x", y: str = "y",
            radius: float | None = None, leaf: int = 32) -> DataFrame:
    """The k nearest reference rows of every distinct query point.

    Returns ``x, y, <ref_id>, distance, neighbour`` (1 = nearest), ordered by
    (distance, id). With ``radius`` only rows closer than it are returned. Rows without
    a finite place are neither queries nor references.
    """
    ids = refs.schema[ref_id].dataType.simpleString()
    q = queries.select(F.col(x).alias("qx"), F.col(y).alias("qy")).where(_placed("qx") & _placed("qy")).distinct()
    r = refs.select(F.col(x).alias("rx"), F.col(y).alias("ry"), F.col(ref_id).alias("rid")).where(_placed("rx") & _placed("ry"))
    # Of many rows on one spot only the k lowest ids can ever be returned.
    r = materialize(top_per_key(r, ["rx", "ry"], ["rid"], k, "_n").drop("_n"), "refs")
    spark = q.sparkSession
    box = r.agg(F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry"), F.count(F.lit(1))).first()
    x0, x1, y0, y1, total = box
    if not total:
        return spark.createDataFrame([], f"{x} double, {y} double, {ref_id} {ids}, distance double, neighbour int")
    side = max(x1 - x0, y1 - y0) * (1.0 + 1e-6) or 1.0
    deepest = max(0, math.ceil(math.log(max(total / leaf, 1.0), 16)))
    while deepest < _MAX_LEVEL and _max_occupancy(r, x0, y0, side / 4**deepest) > leaf:
        deepest += 1
    nodes = materialize(_pyramid(r, x0, y0, side, deepest), "tiles")
    starts = materialize(_start_levels(q, nodes, k, x0, y0, side, deepest), "starts")

    # at most one value per level
    used = {row[0] for row in starts.select("start").distinct().collect()}
    found, carried = [], None
    for level in range(deepest + 1):
        if level not in used and carried is None:
            continue
        edge = side / 4**level
        front = _first_tiles(starts.where(F.col("start") == level), x0, y0, edge, level, radius)
        if carried is not None:
            front = front.unionByName(carried)
        kept = _prune(front, nodes, k, level, x0, y0, edge)
        enough = F.lit(True) if level == deepest else F.col("_left") <= 4 * leaf
        kept = materialize(kept.withColumn("_done", enough), "front")
        points = r.withColumns({"tx": _tile(F.col("rx"), x0, edge), "ty": _tile(F.col("ry"), y0, edge)})
        found.append(kept.where("_done").select("qx", "qy", "tx", "ty").join(points, ["tx", "ty"]).drop("tx", "ty"))
        carried = None
        if level < deepest and not kept.where(~F.col("_done")).isEmpty():
            step = F.sequence(F.lit(0), F.lit(3))
            carried = (
                kept.where(~F.col("_done"))
                .select("qx", "qy", "bound", "tx", "ty", F.explode(step).alias("_i"))
                .select("qx", "qy", "bound", (F.col("tx") * 4 + F.col("_i")).alias("tx"), "ty")
                .select("qx", "qy", "bound", "tx", "ty", F.explode(step).alias("_j"))
                .select("qx", "qy", "bound", "tx", (F.col("ty") * 4 + F.col("_j")).alias("ty"))
            )
    if not found:  # no query points
        found = [starts.select("qx", "qy").join(r, F.lit(False))]
    pairs = reduce(DataFrame.unionByName, found)
    pairs = pairs.withColumn("distance", planar_distance(F.col("qx"), F.col("qy"), F.col("rx"), F.col("ry")))
    if radius is not None:
        pairs = pairs.where(F.col("distance") < F.lit(radius))
    best = top_per_key(pairs, ["qx", "qy"], ["distance", "rid"], k, "neighbour")
    return best.select(F.col("qx").alias(x), F.col("qy").alias(y), F.col("rid").alias(ref_id), "distance", "neighbour")


def _pyramid(r: DataFrame, x0: float, y0: float, side: float, deepest: int) -> DataFrame:
    """Reference rows per tile of every level."""
    edge = side / 4**deepest
    fine = r.groupBy(_tile(F.col("rx"), x0, edge).alias("fx"), _tile(F.col("ry"), y0, edge).alias("fy")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = F.array(*[
        F.struct(F.lit(level).alias("level"), _up(F.col("fx"), deepest - level).alias("tx"),
                 _up(F.col("fy"), deepest - level).alias("ty"))
        for level in range(deepest + 1)])
    return fine.select(F.inline(rows), "n").groupBy("level", "tx", "ty").agg(F.sum("n").alias("n"))


def _start_levels(q: DataFrame, nodes: DataFrame, k: int, x0: float, y0: float, side: float,
                  deepest: int) -> DataFrame:
    """Finest level at which the 3 x 3 tiles around a query hold k rows.

    Decided once per occupied finest tile, not per query. Queries far outside
    the reference extent start at the root.
    """
    offsets = F.sequence(F.lit(-1), F.lit(1))
    around = (
        nodes.select("level", "tx", "ty", "n", F.explode(offsets).alias("_i"))
        .select("level", (F.col("tx") + F.col("_i")).alias("tx"), "ty", "n", F.explode(offsets).alias("_j"))
        .select("level", "tx", (F.col("ty") + F.col("_j")).alias("ty"), "n")
        .groupBy("level", "tx", "ty").agg(F.sum("n").alias("n")).where(F.col("n") >= k).drop("n")
    )
    edge = side / 4**deepest
    q = q.withColumns({"fx": _tile(F.col("qx"), x0, edge), "fy": _tile(F.col("qy"), y0, edge)})
    tiles = q.select("fx", "fy").distinct()

    def hits(levels: range, side_table: DataFrame) -> DataFrame:
        rows = F.array(*[
            F.struct(F.lit(level).alias("level"), _up(F.col("fx"), deepest - level).alias("tx"),
                     _up(F.col("fy"), deepest - level).alias("ty"))
            for level in levels])
        return tiles.select("fx", "fy", F.inline(rows)).join(side_table, ["level", "tx", "ty"]).select("fx", "fy", "level")

    top = range(0, min(deepest, _BROADCAST_LEVEL) + 1)
    hit = hits(top, F.broadcast(around.where(F.col("level") <= _BROADCAST_LEVEL)))
    if deepest > _BROADCAST_LEVEL:
        hit = hit.unionByName(hits(range(_BROADCAST_LEVEL + 1, deepest + 1), around.where(F.col("level") > _BROADCAST_LEVEL)))
    level = hit.groupBy("fx", "fy").agg(F.max("level").alias("start"))
    edges = F.lit(side) / F.pow(F.lit(4.0), F.col("start"))
    return q.join(level, ["fx", "fy"], "left").select(
        "qx", "qy", F.coalesce("start", F.lit(0)).alias("start"),
        # every row of the 3 x 3 tiles is within two tile diagonals
        F.when(F.col("start").isNotNull(), edges * F.lit(2.0 * math.sqrt(2.0) * _SLACK)).alias("bound"))


def _first_tiles(starts: DataFrame, x0: float, y0: float, edge: float, level: int,
                 radius: float | None) -> DataFrame:
    """Tiles of a level within the bound of each query."""
    last = F.lit(4**level - 1).cast("bigint")
    bound = F.coalesce(F.col("bound"), F.lit(float("inf")))
    if radius is not None:
        bound = F.least(bound, F.lit(float(radius)))
    reach = F.least(bound, F.lit(edge * 4.0))  # only the root has an open bound, and it has one tile

    def span(v: str, origin: float) -> Column:
        lo = F.greatest(F.least(_tile(F.col(v) - reach, origin, edge), last), F.lit(0))
        hi = F.greatest(F.least(_tile(F.col(v) + reach, origin, edge), last), F.lit(0))
        return F.sequence(lo, hi)

    return (
        starts.select("qx", "qy", bound.alias("bound"), F.explode(span("qx", x0)).alias("tx"))
        .select("qx", "qy", "bound", "tx", F.explode(span("qy", y0)).alias("ty"))
    )


def _prune(front: DataFrame, nodes: DataFrame, k: int, level: int, x0: float, y0: float,
           edge: float) -> DataFrame:
    """Drop empty tiles and tiles farther than k rows that are surely nearer."""
    here = nodes.where(F.col("level") == level).select("tx", "ty", "n")
    if level <= _BROADCAST_LEVEL:
        here = F.broadcast(here)
    lo_x, lo_y = F.lit(x0) + F.col("tx") * F.lit(edge), F.lit(y0) + F.col("ty") * F.lit(edge)
    hi_x, hi_y = lo_x + F.lit(edge), lo_y + F.lit(edge)

    def length(dx: Column, dy: Column) -> Column:
        return F.sqrt(dx * dx + dy * dy)

    tiles = front.join(here, ["tx", "ty"]).withColumns({
        "_min": length(_gap(F.col("qx"), lo_x, hi_x), _gap(F.col("qy"), lo_y, hi_y)),
        "_max": length(_reach(F.col("qx"), lo_x, hi_x), _reach(F.col("qy"), lo_y, hi_y)),
    })
    own = Window.partitionBy("qx", "qy")
    upto = own.orderBy("_max", "tx", "ty").rowsBetween(Window.unboundedPreceding, 0)
    tiles = tiles.withColumn("_sure", F.when(F.sum("n").over(upto) >= k, F.col("_max")))
    tiles = tiles.withColumn("bound", F.least(F.col("bound"), F.min("_sure").over(own)))
    near = F.col("_min") <= F.col("bound") * F.lit(_SLACK) + F.lit(edge * 1e-9)
    return tiles.where(near).withColumn("_left", F.sum("n").over(own)).select("qx", "qy", "bound", "tx", "ty", "_left")


def exclude_within(df: DataFrame, refs: DataFrame, metres: float, ref_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """Rows whose nearest reference row is at least ``metres`` away."""
    close = nearest(df, refs, ref_id, 1, x, y, radius=metres).select(x, y)
    return df.join(close, [x, y], "left_anti")


def nearest_distance(df: DataFrame, refs: DataFrame, ref_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """Add the distance to the nearest reference row."""
    return df.join(nearest(df, refs, ref_id, 1, x, y).select(x, y, "distance"), [x, y], "left")


def distance_stats(with_distance: DataFrame, below: float) -> DataFrame:
    """min, median, mean of ``distance`` and how many are below a threshold.

    The median is selected in rounds over the written distances; no task holds them all.
    """
    stored = materialize(with_distance.select("distance"), "distances")
    median = F.lit(quantile(stored, "distance")).cast("double")
    return stored.agg(
        F.count("distance").alias("n"), F.min("distance").alias("min_distance"), F.avg("distance").alias("mean_distance"),
        F.count_if(F.col("distance") < F.lit(below)).alias("below")
    ).select("n", "min_distance", median.alias("median_distance"), "mean_distance", "below")


def nearest_label(df: DataFrame, refs: DataFrame, label: str, ref_id: str, x: str = "longitude",
                  y: str = "latitude") -> DataFrame:
    """Add the label of the nearest reference row (lowest id on a tie).

    Rows that share an id count once, with the smallest label among those at the spot found.
    """
    hit = nearest(df, refs, ref_id, 1, x, y).select(x, y, ref_id)
    spots = refs.select(F.col(ref_id), F.col(label), F.col(x).alias("_x"), F.col(y).alias("_y"))
    named = hit.join(spots, ref_id)
    # of the rows with that id, the nearest one; a label of its own kind breaks a tie
    gap = planar_distance(F.col(x), F.col(y), F.col("_x"), F.col("_y"))
    one = named.groupBy(x, y).agg(F.min(F.struct(gap.alias("_gap"), F.col(label))).alias("_one"))
    return df.join(one.select(x, y, F.col("_one")[label].alias(label)), [x, y], "left")


def idw(df: DataFrame, refs: DataFrame, value: str, ref_id: str, k: int = 5, x: str = "longitude",
        y: str = "latitude", digits: int | None = 0) -> DataFrame:
    """Inverse-distance mean of the k nearest reference rows, rounded half-even."""
    hit = nearest(df, refs, ref_id, k, x, y).join(refs.select(ref_id, value), ref_id)
    weight = F.lit(1.0) / F.greatest(F.col("distance"), F.lit(1e-6))
    mean = F.sum(weight * F.col(value)) / F.sum(weight)
    rated = hit.groupBy(x, y).agg((mean if digits is None else F.bround(mean, digits)).alias(value))
    if digits == 0:
        rated = rated.withColumn(value, F.col(value).cast("int"))
    return df.join(rated, [x, y], "left")


def cross_duplicates(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Join pairs on equal columns, counted without forming them."""
    left = a.groupBy(*cols).agg(F.count(F.lit(1)).alias("_a"))
    right = b.groupBy(*cols).agg(F.count(F.lit(1)).alias("_b"))
    return left.join(right, cols).agg(
        F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("pairs"),
        F.count(F.lit(1)).alias("shared_keys"))


def thin_by_spacing(df: DataFrame, metres: float, rank: str, key: str, limit: int | None = None,
                    x: str = "x", y: str = "y") -> DataFrame:
    """Greedy thinning: in rank order, keep a row at least ``metres`` from every kept row.

    Works in rounds over tiles whose diagonal is the spacing, so each tile can
    keep one row. A tile's best row is final once no tile in reach has a better
    one left; everything near it is then dropped. No pairs of candidates are
    formed. ``limit`` keeps the first rows of the full result.

    A row without a coordinate (NULL or NaN) has no place and is never kept. Rows
    without a rank come after all ranked ones; equal ranks are ordered by the key.
    """
    edge = metres / math.sqrt(2.0) * (1.0 - 1e-9)
    placed = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (x, y)]
    pool = (
        df.where(placed[0] & placed[1])
        .select(F.col(rank).isNull().alias("_unranked"), F.col(rank).alias("_rank"), F.col(key).alias("_key"),
                F.col(x).alias("_x"), F.col(y).alias("_y"))
        .withColumns({"_tx": F.floor(F.col("_x") / edge), "_ty": F.floor(F.col("_y") / edge)}))
    kept = _settle(pool, metres)
    if limit is not None:
        kept = with_position(kept, ["_unranked", "_rank", "_key"], "_no").where(F.col("_no") < limit)
    return df.join(kept.select(F.col("_key").alias(key)), key, "left_semi")


def _spread(df: DataFrame, cols: list[str]) -> DataFrame:
    """Copy rows to the 5 x 5 tiles within reach of the spacing."""
    reach = F.sequence(F.lit(-2), F.lit(2))
    return (
        df.select(*cols, "_tx", "_ty", F.explode(reach).alias("_i"))
        .select(*cols, (F.col("_tx") + F.col("_i")).alias("_tx"), "_ty", F.explode(reach).alias("_j"))
        .select(*cols, "_tx", (F.col("_ty") + F.col("_j")).alias("_ty"))
    )


def _drop_near(part: DataFrame, kept: DataFrame, metres: float) -> DataFrame:
    """Rows not within reach of a kept row; kept rows are few per tile by their spacing."""
    near = _spread(kept.select(F.col("_x").alias("_kx"), F.col("_y").alias("_ky"), "_tx", "_ty"), ["_kx", "_ky"])
    close = planar_distance(F.col("_x"), F.col("_y"), F.col("_kx"), F.col("_ky")) < F.lit(metres)
    same = (part["_tx"] == near["_tx"]) & (part["_ty"] == near["_ty"])
    return part.join(near, same & close, "left_anti")


def _settle(pool: DataFrame, metres: float) -> DataFrame:
    tile, row = ["_tx", "_ty"], ["_unranked", "_rank", "_key", "_x", "_y"]
    part = materialize(pool, "open")
    kept = None
    while not part.isEmpty():
        best = part.groupBy(*tile).agg(F.min(F.struct(*row)).alias("_best"))
        around = _spread(best, ["_best"]).groupBy(*tile).agg(F.min("_best").alias("_around"))
        final = best.join(around, tile).where(F.col("_best") == F.col("_around")).select("_best.*", *tile)
        final = materialize(final, "kept")
        if final.isEmpty():
            raise RuntimeError("a round of thinning settled no row")
        kept = final if kept is None else kept.unionByName(final)
        rest = materialize(_drop_near(part, final, metres), "open")
        discard(part)
        part = rest
    return part.select(*row, *tile) if kept is None else kept
