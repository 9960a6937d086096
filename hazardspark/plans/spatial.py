"""Spatial join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import neighbours, spatial
from hazardspark.params import Axis, Box
from hazardspark.plans.registry import query
from hazardspark.plans.tables import cells_meta
from hazardspark.session import new_path
from hazardspark.sources.raster import raster_cells, store_tiles

CELL = "CAST(floor(({lat0} - latitude) / 0.02e0) AS INTEGER)"
ROW = "CAST(floor((27.83e0 - latitude) / 0.02e0) AS INTEGER)"
COL = "CAST(floor((longitude - 88.05e0) / 0.016e0) AS INTEGER)"
LAT_AXIS = Axis(27.025, 0.05, 18)
LON_AXIS = Axis(88.025, 0.05, 17)
METRES = "pts AS (SELECT *, longitude * 98500e0 AS x, latitude * 111000e0 AS y FROM fx_points)"
DIST = "sqrt((a.{x} - b.{x}) * (a.{x} - b.{x}) + (a.{y} - b.{y}) * (a.{y} - b.{y}))"
DM = DIST.format(x="x", y="y")
DD = DIST.format(x="longitude", y="latitude")


def sides(t):
    """Query side (label 0) and reference side (label 1) in local metres."""
    pts = spatial.local_metres(t.fx_points)
    return pts.where(F.col("label") == 0), pts.where(F.col("label") == 1)


SAMPLED = f"""
SELECT p.sl_no, CASE WHEN k.z <> -9999e0 THEN k.z END AS z FROM (SELECT *, {ROW} AS r, {COL} AS c FROM fx_points) p
LEFT JOIN fx_cells k ON k.r = p.r AND k.c = p.c"""


@query("d1_sample_containing", "fx_points fx_cells", SAMPLED)
def d1(t):
    return spatial.sample_containing(t.fx_points, t.fx_cells, cells_meta(t), ["z"]).select("sl_no", "z")


def from_tiles(t, layers):
    """Layers of the points from the raster stored in tiles of 16 x 16 cells."""
    meta = cells_meta(t)
    tiles = store_tiles(t.fx_cells, meta, new_path(t.spark, "tiles"), 16)
    return spatial.stack_tiles(t.fx_points, tiles, meta, layers, 16)


@query("d1_stored_tiles", "fx_points fx_cells", SAMPLED)
def d1_tiles(t):
    return from_tiles(t, {"z": -9999.0}).select("sl_no", "z")


def _axis(v, start, size):
    return f"greatest(least(CAST(ceil(({v} - {start}::DOUBLE) / 0.05::DOUBLE - 0.5::DOUBLE) AS INTEGER), {size - 1}), 0)"


NEAREST = f"(SELECT *, {_axis('latitude', 27.025, 18)} AS lat_i, {_axis('longitude', 88.025, 17)} AS lon_i FROM fx_points)"


@query("d2_sample_nearest_center", "fx_points fx_rain_daily", f"""
, g AS (SELECT CAST(cell_id // 17 AS INTEGER) AS lat_i, CAST(cell_id % 17 AS INTEGER) AS lon_i, max(precip) AS peak FROM fx_rain_daily GROUP BY 1, 2)
SELECT p.sl_no, p.lat_i, p.lon_i, round(27.025::DOUBLE + p.lat_i * 0.05::DOUBLE, 9) AS cell_latitude,
  round(88.025::DOUBLE + p.lon_i * 0.05::DOUBLE, 9) AS cell_longitude, g.peak FROM {NEAREST} p LEFT JOIN g ON g.lat_i = p.lat_i AND g.lon_i = p.lon_i""")
def d2(t):
    grid = t.fx_rain_daily.groupBy(
        F.expr("cell_id div 17").cast("int").alias("lat_i"), (F.col("cell_id") % 17).cast("int").alias("lon_i")
    ).agg(F.max("precip").alias("peak"))
    out = spatial.sample_nearest_center(t.fx_points, grid, LAT_AXIS, LON_AXIS, ["peak"])
    return out.select("sl_no", "lat_i", "lon_i", F.round("cell_latitude", 9).alias("cell_latitude"),
                      F.round("cell_longitude", 9).alias("cell_longitude"), "peak")


@query("d3_sample_rounded_affine", "fx_points fx_cells", """
SELECT p.sl_no, CASE WHEN k.z <> -9999e0 THEN k.z END AS z FROM (SELECT *, CAST(round_even((27.83e0 - latitude) / 0.02e0, 0) AS INTEGER) AS r,
  CAST(round_even((longitude - 88.05e0) / 0.016e0, 0) AS INTEGER) AS c FROM fx_points) p
LEFT JOIN fx_cells k ON k.r = p.r AND k.c = p.c""")
def d3(t):
    return spatial.sample_rounded_affine(t.fx_points, t.fx_cells, cells_meta(t), ["z"]).select("sl_no", "z")


STACK = f"""stacked AS (SELECT p.sl_no, CASE WHEN k.z <> -9999e0 THEN k.z END AS z, k.land_cover
  FROM (SELECT *, {ROW} AS r, {COL} AS c FROM fx_points) p LEFT JOIN fx_cells k ON k.r = p.r AND k.c = p.c)
"""


def stacked(t):
    return spatial.stack_layers(t.fx_points, t.fx_cells, cells_meta(t), {"z": -9999.0, "land_cover": None})


@query("d4_stack_layers", "fx_points fx_cells", ", " + STACK + "SELECT sl_no, z, land_cover FROM stacked")
def d4(t):
    return stacked(t).select("sl_no", "z", "land_cover")


@query("d4_stored_tiles", "fx_points fx_cells", ", " + STACK + "SELECT sl_no, z, land_cover FROM stacked")
def d4_tiles(t):
    return from_tiles(t, {"z": -9999.0, "land_cover": None}).select("sl_no", "z", "land_cover")


@query("d4_missing_per_layer", "fx_points fx_cells", ", " + STACK + """
SELECT count(*) FILTER (WHERE z IS NULL) AS missing_z, count(*) FILTER (WHERE land_cover IS NULL) AS missing_land_cover FROM stacked""")
def d4_missing(t):
    return spatial.missing_per_layer(stacked(t), ["z", "land_cover"])


BOX = Box(27.2, 27.5, 88.2, 88.6)
INSIDE = "latitude BETWEEN 27.2 AND 27.5 AND longitude BETWEEN 88.2 AND 88.6"


@query("d5_coverage", "fx_points", f"""
SELECT count(*) AS points, count(*) FILTER (WHERE {INSIDE}) AS inside, count(*) FILTER (WHERE NOT ({INSIDE})) AS outside,
  round(count(*) FILTER (WHERE {INSIDE}) * 100e0 / count(*), 9) AS pct_inside FROM fx_points""")
def d5(t):
    return spatial.coverage(t.fx_points, BOX).withColumn("pct_inside", F.round("pct_inside", 9))


@query("d6_bbox_filter", "fx_points", f"SELECT sl_no FROM fx_points WHERE {INSIDE}")
def d6(t):
    return spatial.bbox_filter(t.fx_points, BOX).select("sl_no")


@query("d7_nearest_label", "fx_points", f"""
SELECT a.sl_no, (SELECT b.district FROM fx_points b WHERE b.label = 1 ORDER BY {DD}, b.sl_no LIMIT 1) AS near_district
FROM fx_points a WHERE a.label = 0""")
def d7(t):
    q, ref = sides(t)
    out = neighbours.nearest_label(q.drop("district"), ref.withColumnRenamed("sl_no", "ref_no"), "district", "ref_no")
    return out.select("sl_no", F.col("district").alias("near_district"))


KNN = f"""knn AS (SELECT a.sl_no, b.sl_no AS ref_no, {DD} AS dist FROM fx_points a JOIN fx_points b ON a.label = 0 AND b.label = 1
  QUALIFY row_number() OVER (PARTITION BY a.sl_no ORDER BY {DD}, b.sl_no) <= 5)
"""


@query("d8_knn", "fx_points", ", " + KNN + "SELECT sl_no, ref_no, round(dist, 9) AS distance FROM knn")
def d8_knn(t):
    q, ref = sides(t)
    near = neighbours.nearest(q, ref.withColumnRenamed("sl_no", "ref_no"), "ref_no", 5, "longitude", "latitude")
    out = q.select("sl_no", "longitude", "latitude").join(near, ["longitude", "latitude"])
    return out.select("sl_no", "ref_no", F.round("distance", 9).alias("distance"))


@query("d8_idw", "fx_points fx_soil", ", " + KNN + """
SELECT sl_no, round(sum(s.bulk_density / greatest(dist, 1e-6)) / sum(1e0 / greatest(dist, 1e-6)), 6) AS bulk_density
FROM knn JOIN (SELECT sl_no AS ref_no, bulk_density FROM fx_soil) s USING (ref_no) GROUP BY sl_no""")
def d8(t):
    q, ref = sides(t)
    soil = ref.select("sl_no", "longitude", "latitude").join(t.fx_soil.select("sl_no", "bulk_density"), "sl_no")
    out = neighbours.idw(q, soil.withColumnRenamed("sl_no", "ref_no"), "bulk_density", "ref_no", digits=None)
    return out.select("sl_no", F.round("bulk_density", 6).alias("bulk_density"))


@query("d9_exclude_within", "fx_points", f"""
, {METRES} SELECT a.sl_no FROM pts a WHERE a.label = 0 AND NOT EXISTS (SELECT 1 FROM pts b WHERE b.label = 1 AND {DM} < 1500e0)""")
def d9(t):
    q, ref = sides(t)
    return neighbours.exclude_within(q, ref, 1500.0, "sl_no").select("sl_no")


# the sequential rule itself: walk the points by rank and keep the spaced ones
GREEDY = f"""
, {METRES}, o AS (SELECT sl_no, x, y, row_number() OVER (ORDER BY (sl_no * 7919) % 100003, sl_no) AS rn FROM pts)
, walk AS (SELECT 0::BIGINT AS rn, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS kept
  UNION ALL SELECT o.rn, CASE WHEN len(list_filter(kept, lambda k: sqrt((k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y)) < {{metres}})) = 0
    THEN list_append(kept, {{{{'id': o.sl_no, 'x': o.x, 'y': o.y}}}}) ELSE kept END FROM walk JOIN o ON o.rn = walk.rn + 1)
, spaced AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1) z)
"""


def ranked(t):
    return spatial.local_metres(t.fx_points).withColumn("rank", (F.col("sl_no") * 7919) % 100003)


@query("d10_thin_by_spacing", "fx_points", GREEDY.format(metres="2000e0") + "SELECT k.id AS sl_no FROM spaced", recursive=True)
def d10(t):
    return neighbours.thin_by_spacing(ranked(t), 2000.0, "rank", "sl_no").select("sl_no")


@query("d10_thin_first_n", "fx_points", GREEDY.format(metres="800e0") + """
SELECT k.id AS sl_no FROM spaced ORDER BY (k.id * 7919) % 100003, k.id LIMIT 20""", recursive=True)
def d10_limit(t):
    return neighbours.thin_by_spacing(ranked(t), 800.0, "rank", "sl_no", limit=20).select("sl_no")


@query("d11_nearest_distance_stats", "fx_points", f"""
, {METRES}, n AS (SELECT a.sl_no, min({DM}) AS d FROM pts a JOIN pts b ON a.label = 0 AND b.label = 1 GROUP BY a.sl_no)
SELECT count(*) AS n, round(min(d), 6) AS min_distance, round(quantile_cont(d, 0.5), 6) AS median_distance, round(avg(d), 6) AS mean_distance,
  count(*) FILTER (WHERE d < 1000e0) AS below FROM n""")
def d11(t):
    q, ref = sides(t)
    out = neighbours.distance_stats(neighbours.nearest_distance(q, ref, "sl_no"), 1000.0)
    return out.withColumns({c: F.round(c, 6) for c in ("min_distance", "median_distance", "mean_distance")})


@query("d12_cross_duplicates", "fx_points", """
SELECT count(*) AS pairs, count(DISTINCT (a.latitude, a.longitude)) AS shared_keys FROM fx_points a JOIN fx_points b
ON a.label = 0 AND b.label = 1 AND a.latitude = b.latitude AND a.longitude = b.longitude""")
def d12(t):
    q, ref = sides(t)
    return neighbours.cross_duplicates(q, ref, ["latitude", "longitude"])


@query("d13_local_metres", "fx_points", f", {METRES} SELECT sl_no, round(x, 6) AS x, round(y, 6) AS y FROM pts")
def d13(t):
    return spatial.local_metres(t.fx_points).select("sl_no", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


BG_BOX = Box(27.05, 27.85, 88.05, 88.85)


def candidates(t):
    """Background cells of the fixture raster; prices stand in for heights."""
    meta = cells_meta(t)
    cells = raster_cells(t.fx_cells, meta, ["z"]).withColumnRenamed("z", "elevation")
    soil = t.fx_cells.select("r", "c", F.when(F.col("land_cover") != 80, F.lit(100)).otherwise(F.lit(0)).alias("soil"))
    return spatial.background_candidates(cells, soil, BG_BOX, low=900.0, high=1800.0)


CANDIDATES = """SELECT r, c FROM fx_cells WHERE z BETWEEN 900 AND 1800 AND land_cover <> 80
  AND 27.83e0 - (r + 0.5e0) * 0.02e0 BETWEEN 27.05 AND 27.85 AND 88.05e0 + (c + 0.5e0) * 0.016e0 BETWEEN 88.05 AND 88.85"""


@query("d14_background_candidates", "fx_cells", CANDIDATES)
def d14(t):
    return candidates(t).select("r", "c")


@query("d15_axis_swap_check", "fx_points", f"""
, s AS (SELECT sl_no, lat_i, lon_i, CASE WHEN sl_no % 40 = 0 THEN 88.025::DOUBLE + lon_i * 0.05::DOUBLE ELSE 27.025::DOUBLE + lat_i * 0.05::DOUBLE END AS la,
  CASE WHEN sl_no % 40 = 0 THEN 27.025::DOUBLE + lat_i * 0.05::DOUBLE ELSE 88.025::DOUBLE + lon_i * 0.05::DOUBLE END AS lo FROM {NEAREST})
SELECT count(*) AS rows, count(*) FILTER (WHERE la > 50 OR lo < 50) AS swapped,
  count(*) FILTER (WHERE abs(la - (27.025::DOUBLE + lat_i * 0.05::DOUBLE)) > 1e-3 OR abs(lo - (88.025::DOUBLE + lon_i * 0.05::DOUBLE)) > 1e-3) AS not_nearest,
  count(*) FILTER (WHERE la > 50 OR lo < 50) = 0 AS spatial_ok FROM s""")
def d15(t):
    found = spatial.nearest_centre(t.fx_points, LAT_AXIS, LON_AXIS)
    swap = F.col("sl_no") % 40 == 0
    stored = found.withColumns({
        "rainfall_latitude": F.when(swap, F.col("cell_longitude")).otherwise(F.col("cell_latitude")),
        "rainfall_longitude": F.when(swap, F.col("cell_latitude")).otherwise(F.col("cell_longitude")),
    }).drop("lat_i", "lon_i", "cell_latitude", "cell_longitude")
    return spatial.axis_swap_check(stored, LAT_AXIS, LON_AXIS)
