"""Terrain derivatives on a long cell table ``r, c, z``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardspark.params import LAND_COVER, WGS84_A, WGS84_E2, GridMeta

NEIGHBOURS = ("nw", "n", "ne", "w", "o", "e", "sw", "s", "se")
# fixed values: weights of the 3 x 3 neighbourhood, in the order of NEIGHBOURS
EASTWARD = (-1, 0, 1, -2, 0, 2, -1, 0, 1)
NORTHWARD = (1, 2, 1, 0, 0, 0, -1, -2, -1)
SECOND_X = (0, 0, 0, 1, -2, 1, 0, 0, 0)
SECOND_Y = (0, 1, 0, 0, -2, 0, 0, 1, 0)


def pixel_spacing(meta: GridMeta, row: Column) -> tuple[Column, Column]:
    """dx, dy in metres of a raster row on the WGS84 ellipsoid."""
    lat = F.radians(F.lit(meta.lat0) - (row + F.lit(0.5)) * F.lit(meta.dy))
    w = F.lit(1.0) - F.lit(WGS84_E2) * F.sin(lat) * F.sin(lat)
    meridian = F.lit(WGS84_A * (1.0 - WGS84_E2)) / F.pow(w, F.lit(1.5))
    prime = F.lit(WGS84_A) / F.sqrt(w)
    return prime * F.cos(lat) * F.radians(F.lit(meta.dx)), meridian * F.radians(F.lit(meta.dy))


def neighbourhood(cells: DataFrame, meta: GridMeta, value: str = "z", tile: int = 256) -> DataFrame:
    """Each cell with its 3 x 3 values ``z_nw .. z_se``; edges repeat the border.

    Cells are sent to square tiles, border cells also to the tiles beside
    theirs (about 1.6 % more rows). West and east come from the row, north and
    south from the column of the tile, so one shuffle serves the whole stencil.
    Where a cell is absent, the corners behind it are NULL as well; kernels are
    NULL there in any case.
    """
    def owners(v: Column, size: int) -> Column:
        lo, hi = F.greatest(v - 1, F.lit(0)), F.least(v + 1, F.lit(size - 1))
        return F.array_distinct(F.array(*[F.floor(x / tile).cast("int") for x in (lo, v, hi)]))

    spread = (
        cells.select("r", "c", F.col(value).alias("_z"))
        .withColumn("_tr", F.explode(owners(F.col("r"), meta.height)))
        .withColumn("_tc", F.explode(owners(F.col("c"), meta.width)))
        .repartition("_tr", "_tc")
    )
    along = Window.partitionBy("_tr", "_tc", "r").orderBy("c")
    down = Window.partitionBy("_tr", "_tc", "c").orderBy("r")

    def beside(window, pos: str, step: int, edge: int, item: Column) -> Column:
        """The item one step away if that cell exists, the own item at the edge."""
        there = F.lag(item, -step).over(window)
        adjacent = F.lag(F.col(pos), -step).over(window) == F.col(pos) + step
        return F.when(F.col(pos) == edge, item).when(adjacent, there)

    rows = spread.withColumn("_row", F.struct(
        beside(along, "c", -1, 0, F.col("_z")).alias("w"), F.col("_z").alias("o"),
        beside(along, "c", 1, meta.width - 1, F.col("_z")).alias("e")))
    full = rows.withColumns({
        "_up": beside(down, "r", -1, 0, F.col("_row")),
        "_down": beside(down, "r", 1, meta.height - 1, F.col("_row")),
    })
    core = (F.floor(F.col("r") / tile) == F.col("_tr")) & (F.floor(F.col("c") / tile) == F.col("_tc"))
    return full.where(core).select(
        "r", "c",
        F.col("_up.w").alias("z_nw"), F.col("_up.o").alias("z_n"), F.col("_up.e").alias("z_ne"),
        F.col("_row.w").alias("z_w"), F.col("_row.o").alias("z_o"), F.col("_row.e").alias("z_e"),
        F.col("_down.w").alias("z_sw"), F.col("_down.o").alias("z_s"), F.col("_down.e").alias("z_se"))


def kernel(weights: tuple) -> Column:
    """Weighted 3 x 3 sum; NULL if any of the nine cells is NULL."""
    terms = [F.lit(float(w)) * F.col(f"z_{n}") for n, w in zip(NEIGHBOURS, weights) if w]
    known = reduce(lambda a, b: a & b, [F.col(f"z_{n}").isNotNull() for n in NEIGHBOURS])
    return F.when(known, reduce(lambda a, b: a + b, terms))


def stencil3x3(cells: DataFrame, meta: GridMeta, kernels: dict[str, tuple], value: str = "z") -> DataFrame:
    around = neighbourhood(cells, meta, value)
    return around.select("r", "c", F.col("z_o").alias(value), *[kernel(w).alias(k) for k, w in kernels.items()])


def derivatives(cells: DataFrame, meta: GridMeta, value: str = "z", direction: str = "downslope") -> DataFrame:
    """slope, aspect (degrees) and curvature of every cell.

    Aspect is the compass bearing of steepest descent, -1 where the slope is
    below 0.1 degree; ``direction='upslope'`` turns it round.
    """
    sums = stencil3x3(cells, meta, {"_px": EASTWARD, "_py": NORTHWARD, "_xx": SECOND_X, "_yy": SECOND_Y}, value)
    dx, dy = pixel_spacing(meta, F.col("r"))
    d = sums.withColumns({"_dx": dx, "_dy": dy})
    d = d.withColumns({"_p": F.col("_px") / (F.lit(8.0) * F.col("_dx")), "_q": F.col("_py") / (F.lit(8.0) * F.col("_dy"))})
    slope = F.degrees(F.atan(F.sqrt(F.col("_p") * F.col("_p") + F.col("_q") * F.col("_q"))))
    sign = {"downslope": -1.0, "upslope": 1.0}[direction]
    bearing = F.degrees(F.atan2(F.lit(sign) * F.col("_p"), F.lit(sign) * F.col("_q")))
    d = d.withColumns({"slope": slope, "_bearing": bearing})
    turned = (
        F.when(F.col("slope") < 0.1, F.lit(-1.0))
        .when((F.col("_bearing") < 0) & (F.col("_bearing") >= -1e-6), F.lit(0.0))
        .when(F.col("_bearing") < 0, F.col("_bearing") + 360.0)
        .when(F.col("_bearing") >= 360.0, F.col("_bearing") - 360.0)
        .otherwise(F.col("_bearing"))
    )
    bend = F.lit(-100.0) * (F.col("_xx") / (F.col("_dx") * F.col("_dx")) + F.col("_yy") / (F.col("_dy") * F.col("_dy")))
    return d.select("r", "c", value, "slope", turned.alias("aspect"), bend.alias("curvature"))


def layer_stats(terrain: DataFrame, elevation: str = "z") -> DataFrame:
    """min, max, mean and population std per layer; aspect over sloping cells only."""
    layers = {"elevation": F.col(elevation), "slope": F.col("slope"), "curvature": F.col("curvature"),
              "aspect": F.when(F.col("aspect") >= 0, F.col("aspect"))}
    rows = F.array(*[
        F.struct(F.lit(k).alias("layer"), F.count(v).alias("cells"), F.min(v).alias("min"), F.max(v).alias("max"),
                 F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
        for k, v in layers.items()])
    return terrain.agg(rows.alias("_r")).select(F.inline("_r"))


def class_histogram(cells: DataFrame, code: str, names: dict[int, str] = LAND_COVER) -> DataFrame:
    """Cells and percent per class; codes without a name are 'Unknown Class'."""
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    counts = cells.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("cells"))
    # one row per class code from here on
    from_all = Window.partitionBy()
    return counts.select(
        "code", F.coalesce(F.try_element_at(lookup, F.col("code").cast("int")), F.lit("Unknown Class")).alias("class_name"),
        "cells", (F.col("cells") * F.lit(100.0) / F.sum("cells").over(from_all)).alias("pct"))


def class_range(cells: DataFrame, code: str) -> DataFrame:
    return cells.agg(F.min(code).alias("min_class"), F.max(code).alias("max_class"),
                     F.count_distinct(code).alias("distinct_classes"))


def valid_mask(value: Column, nodata: float | None) -> Column:
    known = value.isNotNull() & ~F.isnan(value.cast("double"))
    return known if nodata is None else known & (value != F.lit(nodata))


def raster_validity(cells: DataFrame, value: str, nodata: float | None) -> DataFrame:
    ok = valid_mask(F.col(value), nodata)
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(ok).alias("valid"),
                     F.coalesce(F.bool_and(~ok), F.lit(True)).alias("all_nodata"))
