"""Raster and terrain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import terrain
from hazardspark.plans.registry import query
from hazardspark.plans.tables import cells_meta
from hazardspark.sources.raster import raster_cells

SPACING = """
, size AS (SELECT max(r) + 1 AS h FROM fx_cells)
, lat AS (SELECT DISTINCT r, radians(27.83e0 - (r + 0.5e0) * 0.02e0) AS phi FROM fx_cells)
, sp AS (SELECT r, 6378137e0 / sqrt(1 - 0.00669437999014e0 * sin(phi) * sin(phi)) * cos(phi) * radians(0.016e0) AS dx,
    6378137e0 * (1 - 0.00669437999014e0) / pow(1 - 0.00669437999014e0 * sin(phi) * sin(phi), 1.5e0) * radians(0.02e0) AS dy FROM lat)
, base AS (SELECT r, c, CASE WHEN z <> -9999e0 THEN z END AS z, land_cover FROM fx_cells)
"""


def _cell(dr, dc):
    """Value of a neighbour whose key is clamped to the grid."""
    return (f"LEFT JOIN base k{dr + 1}{dc + 1} ON k{dr + 1}{dc + 1}.r = least(greatest(o.r + ({dr}), 0), size.h - 1) "
            f"AND k{dr + 1}{dc + 1}.c = least(greatest(o.c + ({dc}), 0), 49)")


JOINS = " ".join(_cell(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1))
KNOWN = " AND ".join(f"k{a}{b}.z IS NOT NULL" for a in range(3) for b in range(3))
STENCIL = SPACING + f"""
, st AS (SELECT o.r, o.c, o.z,
    CASE WHEN {KNOWN} THEN k02.z + 2 * k12.z + k22.z - k00.z - 2 * k10.z - k20.z END AS px,
    CASE WHEN {KNOWN} THEN k00.z + 2 * k01.z + k02.z - k20.z - 2 * k21.z - k22.z END AS py,
    CASE WHEN {KNOWN} THEN k10.z - 2 * k11.z + k12.z END AS xx,
    CASE WHEN {KNOWN} THEN k01.z - 2 * k11.z + k21.z END AS yy
  FROM base o CROSS JOIN size {JOINS})
, pq AS (SELECT st.*, px / (8 * dx) AS p, py / (8 * dy) AS q, dx, dy FROM st JOIN sp ON sp.r = st.r)
, sl AS (SELECT *, degrees(atan(sqrt(p * p + q * q))) AS slope, degrees(atan2(-p, -q)) AS b FROM pq)
, terrain AS (SELECT r, c, z, slope, CASE WHEN slope < 0.1 THEN -1e0 WHEN b < 0 AND b >= -1e-6 THEN 0e0 WHEN b < 0 THEN b + 360 ELSE b END AS aspect,
    -100 * (xx / (dx * dx) + yy / (dy * dy)) AS curvature FROM sl)
"""


def base(t):
    return raster_cells(t.fx_cells, cells_meta(t), ["z"]).select("r", "c", "z", "land_cover")


def _terrain(t, **kw):
    return terrain.derivatives(base(t), cells_meta(t), **kw)


@query("e1_pixel_spacing", "fx_cells", SPACING + "SELECT r, round(dx, 6) AS dx, round(dy, 6) AS dy FROM sp")
def e1(t):
    dx, dy = terrain.pixel_spacing(cells_meta(t), F.col("r"))
    return t.fx_cells.select("r").distinct().select("r", F.round(dx, 6).alias("dx"), F.round(dy, 6).alias("dy"))


@query("e2_stencil3x3", "fx_cells", STENCIL + """
SELECT r, c, z, round(px, 6) AS px, round(py, 6) AS py, round(xx, 6) AS xx, round(yy, 6) AS yy FROM st""")
def e2(t):
    kernels = {"px": terrain.EASTWARD, "py": terrain.NORTHWARD, "xx": terrain.SECOND_X, "yy": terrain.SECOND_Y}
    out = terrain.stencil3x3(base(t), cells_meta(t), kernels)
    return out.withColumns({c: F.round(c, 6) for c in kernels})


@query("e3_slope", "fx_cells", STENCIL + "SELECT r, c, round(slope, 8) AS slope FROM terrain")
def e3(t):
    return _terrain(t).select("r", "c", F.round("slope", 8).alias("slope"))


@query("e4_aspect", "fx_cells", STENCIL + "SELECT r, c, round(aspect, 6) AS aspect FROM terrain")
def e4(t):
    return _terrain(t).select("r", "c", F.round("aspect", 6).alias("aspect"))


@query("e4_aspect_upslope", "fx_cells", STENCIL + """
SELECT r, c, round(CASE WHEN slope < 0.1 THEN -1e0 WHEN degrees(atan2(p, q)) < 0 THEN degrees(atan2(p, q)) + 360 ELSE degrees(atan2(p, q)) END, 6) AS aspect FROM sl""")
def e4_up(t):
    return _terrain(t, direction="upslope").select("r", "c", F.round("aspect", 6).alias("aspect"))


@query("e5_curvature", "fx_cells", STENCIL + "SELECT r, c, round(curvature, 10) AS curvature FROM terrain")
def e5(t):
    return _terrain(t).select("r", "c", F.round("curvature", 10).alias("curvature"))


@query("e6_layer_stats", "fx_cells", STENCIL + " UNION ALL ".join(
    f"SELECT '{name}' AS layer, count({v}) AS cells, round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std FROM terrain"
    for name, v in (("elevation", "z"), ("slope", "slope"), ("curvature", "curvature"), ("aspect", "CASE WHEN aspect >= 0 THEN aspect END"))))
def e6(t):
    out = terrain.layer_stats(_terrain(t))
    return out.withColumns({c: F.round(c, 6) for c in ("min", "max", "mean", "std")})


NAMED = "CASE land_cover WHEN 10 THEN 'Tree cover' WHEN 30 THEN 'Grassland' WHEN 50 THEN 'Built-up' WHEN 60 THEN 'Bare / sparse vegetation' ELSE 'Unknown Class' END"


@query("e7_class_histogram", "fx_cells", f"""
SELECT land_cover AS code, {NAMED} AS class_name, count(*) AS cells, round(count(*) * 100e0 / (SELECT count(*) FROM fx_cells), 9) AS pct
FROM fx_cells GROUP BY land_cover""")
def e7(t):
    names = {k: v for k, v in terrain.LAND_COVER.items() if k != 80}
    return terrain.class_histogram(t.fx_cells, "land_cover", names).withColumn("pct", F.round("pct", 9))


@query("e7_class_range", "fx_cells", "SELECT min(land_cover) AS min_class, max(land_cover) AS max_class, count(DISTINCT land_cover) AS distinct_classes FROM fx_cells")
def e7_range(t):
    return terrain.class_range(t.fx_cells, "land_cover")


@query("e8_raster_validity", "fx_cells", """
SELECT count(*) AS cells, count(*) FILTER (WHERE z <> -9999e0) AS valid, count(*) FILTER (WHERE z <> -9999e0) = 0 AS all_nodata FROM fx_cells""")
def e8(t):
    return terrain.raster_validity(t.fx_cells, "z", -9999.0)
