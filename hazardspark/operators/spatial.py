"""Point-to-cell joins and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardspark.functions.numeric import nan_to_null
from hazardspark.params import METRES_PER_DEG_LAT, METRES_PER_DEG_LON, Axis, Box, GridMeta
from hazardspark.sources.raster import TILE, tile_count, tile_of

_MOST_TILES = 1_000_000  # tile numbers broadcast at most: 4 MB


def _lookup(points: DataFrame, cells: DataFrame, values: list[str], nodata: dict[str, float | None]) -> DataFrame:
    """Left equi-join on the cell key; every layer comes from one wide row."""
    def clean(c: str) -> Column:
        value = F.col(c)
        mark = nodata.get(c)
        return F.when(value >= 0, value) if mark is None else F.when(value != F.lit(mark), value)

    # Cell keys are unique, so this never multiplies rows; a cell that very many
    # points fall into is split by adaptive execution.
    layer = cells.select(F.col("r").alias("_r"), F.col("c").alias("_c"), *[clean(c).alias(c) for c in values])
    return points.join(layer, ["_r", "_c"], "left")


def _as_cell(index: Column, size: int) -> Column:
    """Integer index on the grid, NULL off the grid."""
    return F.when((index >= 0) & (index < size), index.cast("int"))


def cell_of(points: DataFrame, meta: GridMeta, mode: str = "containing", lat: str = "latitude",
            lon: str = "longitude") -> DataFrame:
    """Add the cell key ``_r, _c``: the containing pixel, or the rounded inverse
    affine (half a pixel off, kept for parity)."""
    col = nan_to_null((F.col(lon) - F.lit(meta.lon0)) / F.lit(meta.dx))  # rounding would turn NaN into 0
    row = nan_to_null((F.lit(meta.lat0) - F.col(lat)) / F.lit(meta.dy))
    if mode == "containing":
        col, row = F.floor(col), F.floor(row)
    elif mode == "rounded":
        col, row = F.bround(col, 0), F.bround(row, 0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return points.withColumns({"_r": _as_cell(row, meta.height), "_c": _as_cell(col, meta.width)})


def sample_containing(points: DataFrame, cells: DataFrame, meta: GridMeta, values: list[str]) -> DataFrame:
    nodata = {c: meta.nodata for c in values}
    return _lookup(cell_of(points, meta), cells, values, nodata).drop("_r", "_c")


def sample_rounded_affine(points: DataFrame, cells: DataFrame, meta: GridMeta, values: list[str]) -> DataFrame:
    nodata = {c: meta.nodata for c in values}
    return _lookup(cell_of(points, meta, "rounded"), cells, values, nodata).drop("_r", "_c")


def nearest_index(v: Column, axis: Axis) -> Column:
    """Index of the nearest axis value, the lower index on a tie, clamped."""
    raw = F.ceil((v - F.lit(axis.start)) / F.lit(axis.step) - F.lit(0.5))
    return F.greatest(F.least(raw, F.lit(axis.size - 1)), F.lit(0)).cast("int")


def nearest_centre(points: DataFrame, lat_axis: Axis, lon_axis: Axis, lat: str = "latitude",
                   lon: str = "longitude") -> DataFrame:
    """Add the nearest cell's indices and coordinates."""
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    found = points.withColumns({
        "lat_i": F.when(known, nearest_index(F.col(lat), lat_axis)),
        "lon_i": F.when(known, nearest_index(F.col(lon), lon_axis)),
    })
    return found.withColumns({
        "cell_latitude": F.lit(lat_axis.start) + F.col("lat_i") * F.lit(lat_axis.step),
        "cell_longitude": F.lit(lon_axis.start) + F.col("lon_i") * F.lit(lon_axis.step),
    })


def sample_nearest_center(points: DataFrame, grid: DataFrame, lat_axis: Axis, lon_axis: Axis,
                          values: list[str]) -> DataFrame:
    """Values of the nearest cell; ``grid`` is keyed by ``lat_i, lon_i``."""
    found = nearest_centre(points, lat_axis, lon_axis)
    return found.join(grid.select("lat_i", "lon_i", *values), ["lat_i", "lon_i"], "left")


def stack_layers(points: DataFrame, cells: DataFrame, meta: GridMeta, layers: dict[str, float | None]) -> DataFrame:
    """One column per layer (``name -> nodata``) for one shuffle of the points.

    A layer without declared nodata treats negative values as missing.
    """
    return _lookup(cell_of(points, meta), cells, list(layers), layers).drop("_r", "_c")


def stack_tiles(points: DataFrame, tiles: DataFrame, meta: GridMeta, layers: dict[str, float | None],
                size: int = TILE, mode: str = "containing") -> DataFrame:
    """:func:`stack_layers` on stored tiles (``raster.store_tiles`` with the same ``size``).

    The tiles that hold points reach the scan as a runtime filter on its folders, so
    the others are never opened. The grid bounds how many tile numbers are broadcast;
    a grid of more tiles than that is joined without.
    """
    placed = cell_of(points, meta, mode)
    number = tile_of(meta, size, "_r", "_c")
    wanted = placed.select(number.alias("tile")).where(F.col("tile") >= 0).distinct()
    if tile_count(meta, size) <= _MOST_TILES:
        wanted = F.broadcast(wanted)
    return _lookup(placed, tiles.join(wanted, "tile", "left_semi"), list(layers), layers).drop("_r", "_c")


def missing_per_layer(df: DataFrame, layers: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in layers])


def in_box(box: Box, lat: str = "latitude", lon: str = "longitude") -> Column:
    """Closed on all sides."""
    return F.col(lat).between(box.lat_min, box.lat_max) & F.col(lon).between(box.lon_min, box.lon_max)


def bbox_filter(df: DataFrame, box: Box, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.where(in_box(box, lat, lon))


def coverage(points: DataFrame, box: Box) -> DataFrame:
    inside = F.coalesce(in_box(box), F.lit(False))
    n = F.count(F.lit(1))
    return points.agg(
        n.alias("points"), F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"),
        F.try_divide(F.count_if(inside) * F.lit(100.0), n.cast("double")).alias("pct_inside"))


def local_metres(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Planar metres ``x, y`` of the pilot region."""
    return df.withColumns({"x": F.col(lon) * F.lit(METRES_PER_DEG_LON), "y": F.col(lat) * F.lit(METRES_PER_DEG_LAT)})


def background_candidates(cells: DataFrame, soil: DataFrame, box: Box, elevation: str = "elevation",
                          low: float = 200.0, high: float = 4500.0, seed: int = 42) -> DataFrame:
    """Cells fit for background samples with a reproducible random rank.

    ``cells`` carries ``r, c, latitude, longitude`` and the elevation;
    ``soil`` is ``r, c, soil`` on the same grid.
    """
    fit = bbox_filter(cells.where(F.col(elevation).between(low, high)), box)
    fit = fit.join(soil.where(F.col("soil") > 0), ["r", "c"], "left_semi")
    return fit.withColumn("rank", F.xxhash64(F.lit(seed), "r", "c"))


def axis_swap_check(df: DataFrame, lat_axis: Axis, lon_axis: Axis, tol: float = 1e-3,
                    cell_lat: str = "rainfall_latitude", cell_lon: str = "rainfall_longitude") -> DataFrame:
    """Swapped coordinates, and stored cells that are not the nearest ones."""
    again = nearest_centre(df, lat_axis, lon_axis)
    swapped = (F.col(cell_lat) > 50.0) | (F.col(cell_lon) < 50.0)
    off = (F.abs(F.col(cell_lat) - F.col("cell_latitude")) > tol) | (F.abs(F.col(cell_lon) - F.col("cell_longitude")) > tol)
    out = again.agg(F.count(F.lit(1)).alias("rows"), F.count_if(swapped).alias("swapped"), F.count_if(off).alias("not_nearest"))
    return out.withColumn("spatial_ok", (F.col("swapped") == 0) & (F.col("not_nearest") == 0))
