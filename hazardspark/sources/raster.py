"""Rasters and daily grids as long cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardspark.functions.numeric import nan_to_null
from hazardspark.params import Box, GridMeta

DAY_ZERO = "1980-01-01"  # fixed value: origin of the day-offset time axis
TILE = 1024  # cells along an edge of a stored tile


def raster_cells(df: DataFrame, meta: GridMeta, values: list[str]) -> DataFrame:
    """nodata and NaN -> NULL, and the lon/lat of every cell centre."""
    def clean(c: str):
        value = nan_to_null(F.col(c).cast("double"))
        return value if meta.nodata is None else F.when(value != F.lit(meta.nodata), value)

    lon = F.lit(meta.lon0) + (F.col("c") + F.lit(0.5)) * F.lit(meta.dx)
    lat = F.lit(meta.lat0) - (F.col("r") + F.lit(0.5)) * F.lit(meta.dy)
    return df.withColumns({**{c: clean(c) for c in values}, "longitude": lon, "latitude": lat})


def tile_of(meta: GridMeta, size: int, r: str = "r", c: str = "c") -> Column:
    """Number of the square of ``size`` x ``size`` cells that holds a cell, row by row."""
    across = -(-meta.width // size)
    return (F.floor(F.col(r) / size) * across + F.floor(F.col(c) / size)).cast("int")


def tile_count(meta: GridMeta, size: int) -> int:
    return -(-meta.width // size) * -(-meta.height // size)


def store_tiles(cells: DataFrame, meta: GridMeta, path: str, size: int = TILE) -> DataFrame:
    """Write cells (``r, c`` and layers) in a folder per tile and read them back with their ``tile``.

    A tile is rebalanced into few files; one too large for a task is split.
    """
    tiled = cells.withColumn("tile", tile_of(meta, size))
    tiled.hint("rebalance", "tile").write.partitionBy("tile").parquet(path)
    return cells.sparkSession.read.schema(tiled.schema).parquet(path)


def daily_grid(df: DataFrame, offset: str = "t", value: str = "precip") -> DataFrame:
    """Day offset -> DATE, with year and month for partitioned storage; fill -> NULL."""
    known = nan_to_null(F.col(value).cast("double"))
    d = F.date_add(F.lit(DAY_ZERO).cast("date"), F.col(offset))
    return df.select(
        *[c for c in df.columns if c not in (offset, value)], d.alias("d"),
        F.when(known >= 0, known).alias(value), F.year(d).alias("year"), F.month(d).alias("month"))


def write_daily(df: DataFrame, path: str) -> None:
    """Store by year and month.

    The rebalance hint gathers each month into few files and lets adaptive
    execution split a month that is too large for one task.
    """
    df.hint("rebalance", "year", "month").write.partitionBy("year", "month").parquet(path)


def window_read(df: DataFrame, box: Box, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows inside a closed box; the bounds reach the parquet scan."""
    return df.where(F.col(lat).between(box.lat_min, box.lat_max) & F.col(lon).between(box.lon_min, box.lon_max))


def _spread(v: Column) -> Column:
    """The 16 low bits of ``v`` with a zero between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def curve_key(box: Box, lat: str = "latitude", lon: str = "longitude") -> Column:
    """Place along a Z-order curve through 65,536 x 65,536 steps of ``box``; NULL without a place.

    Points outside the box count as on its edge: it shapes the order, it drops nothing.
    """
    def step(name: str, low: float, high: float) -> Column:
        value = nan_to_null(F.col(name).cast("double"))
        at = (value - F.lit(low)) / F.lit(high - low) * F.lit(65536.0)
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(65535.0), at))).cast("bigint")

    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    along = _spread(step(lat, box.lat_min, box.lat_max)).bitwiseOR(F.shiftleft(_spread(step(lon, box.lon_min, box.lon_max)), 1))
    return F.when(known, along)


def write_clustered(df: DataFrame, path: str, box: Box, lat: str = "latitude", lon: str = "longitude",
                    page_rows: int = 20_000) -> None:
    """Store rows along a space-filling curve, so that :func:`window_read` reads few pages.

    Neighbours share files, row groups and pages, whose bounds in the footer let
    the scan pass over the rest. The hash of a row's number is the second sort key:
    a place that very many rows share, copies included, is spread over tasks.
    """
    keyed = df.withColumns({"_curve": curve_key(box, lat, lon), "_hash": F.xxhash64(F.monotonically_increasing_id())})
    ordered = keyed.repartitionByRange("_curve", "_hash").sortWithinPartitions("_curve", "_hash")
    ordered.drop("_curve", "_hash").write.option("parquet.page.row.count.limit", page_rows).parquet(path)


def month_scan(df: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of the wanted months; on partitioned storage other months are not opened."""
    return df.join(months.select("year", "month"), ["year", "month"], "left_semi")
