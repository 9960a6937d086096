"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import catalogue
from hazardspark.params import Box, GridMeta
from hazardspark.plans.registry import query
from hazardspark.session import new_path
from hazardspark.sources import raster, tables

POINTS = "sl_no bigint, slide_name string, district string, material string, latitude double, longitude double, label int"
CELLS_META = dict(lon0=88.05, lat0=27.83, dx=0.016, dy=0.02, width=50, nodata=-9999.0)


def cells_meta(t) -> GridMeta:
    """Metadata of the fixture raster; its height grows with the data."""
    height = t.fx_cells.agg(F.max("r")).first()[0] + 1
    return GridMeta(height=height, **CELLS_META)


@query("a1_read_table", "fx_points", "SELECT * FROM fx_points")
def a1(t):
    path = new_path(t.spark, "points-csv")
    tables.write_table(t.fx_points, path, "csv")
    return tables.read_table(t.spark, path, POINTS)


@query("a2_read_features", "fx_points", "SELECT latitude, longitude, sl_no, slide_name, district, label FROM fx_points")
def a2(t):
    path = new_path(t.spark, "points-geojson")
    tables.to_geojson(t.fx_points).write.text(path)
    return tables.read_features(t.spark, path, "sl_no bigint, slide_name string, district string, label int")


@query("a3_merge_fragments", "", """
SELECT CAST(p_partkey % 3 AS INTEGER) AS fragment, CAST(p_partkey + 1 AS BIGINT) AS row_no,
  CASE WHEN p_partkey % 3 < 2 THEN CAST(p_partkey AS VARCHAR) END AS "sl.no",
  CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type END AS kind,
  CASE WHEN p_partkey % 3 = 2 AND p_partkey <> 2 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey = 2 THEN CAST(p_partkey AS VARCHAR) END AS "0",
  CASE WHEN p_partkey % 3 = 2 THEN p_name END AS "1"
FROM part""")
def a3(t):
    part = t.part
    key = F.col("p_partkey").cast("string")
    cells = (
        F.when(F.col("p_partkey") % 3 == 0, F.array(key, "p_name", "p_brand"))
        .when(F.col("p_partkey") % 3 == 1, F.array("p_type", key))
        .otherwise(F.array(key, "p_name"))
    )
    body = part.select((F.col("p_partkey") % 3).cast("int").alias("fragment"),
                       (F.col("p_partkey") + 1).alias("row_no"), cells.alias("cells"))
    # The third fragment has no header: its first body row takes row number 0.
    first = F.col("fragment") == 2
    body = body.withColumn("row_no", F.when(first, F.col("row_no") - 3).otherwise(F.col("row_no")))
    heads = t.spark.createDataFrame(
        [(0, 0, ["sl.no", "name", "kind"]), (1, 0, ["kind", "sl.no"])], "fragment int, row_no bigint, cells array<string>")
    merged = tables.merge_fragments(body.unionByName(heads))
    return merged.withColumn("row_no", F.when(F.col("fragment") == 2, F.col("row_no") + 3).otherwise(F.col("row_no")))


@query("a4_raster_cells", "fx_cells", """
SELECT r, c, CASE WHEN z <> -9999e0 THEN z END AS z, land_cover, round(88.05e0 + (c + 0.5e0) * 0.016e0, 9) AS longitude,
  round(27.83e0 - (r + 0.5e0) * 0.02e0, 9) AS latitude FROM fx_cells""")
def a4(t):
    meta = GridMeta(height=0, **CELLS_META)
    out = raster.raster_cells(t.fx_cells, meta, ["z"])
    return out.withColumns({c: F.round(c, 9) for c in ("longitude", "latitude")})


def _offsets(t):
    days = F.datediff("d", F.lit("1980-01-01").cast("date"))
    value = F.when(F.col("cell_id") % 7 == 3, F.lit(-9999.0)).otherwise(F.col("precip"))
    return t.fx_rain_daily.select("cell_id", days.alias("t"), value.alias("precip"))


@query("a5_daily_grid", "fx_rain_daily", """
SELECT cell_id, d, CASE WHEN cell_id % 7 <> 3 THEN precip END AS precip, CAST(year(d) AS INTEGER) AS year,
  CAST(month(d) AS INTEGER) AS month FROM fx_rain_daily""")
def a5(t):
    path = new_path(t.spark, "daily")
    raster.write_daily(raster.daily_grid(_offsets(t)), path)
    return t.spark.read.parquet(path).select("cell_id", "d", "precip", "year", "month")


WINDOW = """
SELECT sl_no, latitude, longitude FROM fx_points
WHERE latitude BETWEEN 27.2 AND 27.5 AND longitude BETWEEN 88.2 AND 88.6"""


@query("a6_window_read", "fx_points", WINDOW)
def a6(t):
    path = new_path(t.spark, "points")
    t.fx_points.write.parquet(path)
    box = Box(27.2, 27.5, 88.2, 88.6)
    return raster.window_read(t.spark.read.parquet(path), box).select("sl_no", "latitude", "longitude")


@query("a6_clustered_window", "fx_points", WINDOW)
def a6_clustered(t):
    """The same window from rows stored along a space-filling curve."""
    path = new_path(t.spark, "points-curve")
    raster.write_clustered(t.fx_points, path, Box(27.0, 28.0, 88.0, 89.0))
    box = Box(27.2, 27.5, 88.2, 88.6)
    return raster.window_read(t.spark.read.schema(POINTS).parquet(path), box).select("sl_no", "latitude", "longitude")


@query("a7_month_scan", "", """
WITH big AS (SELECT CAST(o_orderdate AS DATE) AS event_date FROM orders WHERE o_totalprice > 495000)
, months AS (SELECT DISTINCT year(d) AS y, month(d) AS m FROM (SELECT event_date - CAST(l.lag AS INTEGER) AS d FROM big
  CROSS JOIN (SELECT unnest(range(0, 7)) AS lag) l) x)
SELECT o_orderkey AS cell_id, CAST(o_orderdate AS DATE) AS d, o_totalprice AS precip,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
FROM orders WHERE (year(o_orderdate), month(o_orderdate)) IN (SELECT (y, m) FROM months)""")
def a7(t):
    d = F.col("o_orderdate").cast("date")
    daily = t.orders.select(F.col("o_orderkey").alias("cell_id"), d.alias("d"), F.col("o_totalprice").alias("precip"),
                            F.year(d).alias("year"), F.month(d).alias("month"))
    path = new_path(t.spark, "daily-orders")
    raster.write_daily(daily, path)
    events = t.orders.where(F.col("o_totalprice") > 495000).select(d.alias("event_date"))
    months = catalogue.required_months(events)
    return raster.month_scan(t.spark.read.parquet(path), months).select("cell_id", "d", "precip", "year", "month")


@query("a8_file_inventory")
def a8(t):
    return tables.file_inventory(t.spark, t.folder)


@query("a8_written_files", "", """
SELECT '.txt' AS extension, count(DISTINCT p_size) AS files, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS bytes FROM part
UNION ALL SELECT '.csv', count(DISTINCT c_nationkey), CAST(sum(strlen(CAST(c_custkey AS VARCHAR)) + 1) AS BIGINT) FROM customer
UNION ALL SELECT '.json', count(DISTINCT o_orderstatus), CAST(sum(strlen('{"o_orderkey":' || o_orderkey || '}') + 1) AS BIGINT) FROM orders""")
def a8_written(t):
    """Inventory of a folder of known files: a table each as text, CSV and JSON, one file per key."""
    path = new_path(t.spark, "inventory")
    for fmt, table, key, value in (("text", t.part, "p_size", "p_name"), ("csv", t.customer, "c_nationkey", "c_custkey"),
                                   ("json", t.orders, "o_orderstatus", "o_orderkey")):
        table.select(key, value).repartition(key).write.partitionBy(key).format(fmt).save(f"{path}/{fmt}")
    return tables.file_inventory(t.spark, path)


@query("a9_write_table", "fx_points", """
SELECT 'csv' AS fmt, count(*) AS rows, CAST(sum(sl_no) AS BIGINT) AS id_sum FROM fx_points
UNION ALL SELECT 'json', count(*), CAST(sum(sl_no) AS BIGINT) FROM fx_points
UNION ALL SELECT 'parquet', count(*), CAST(sum(sl_no) AS BIGINT) FROM fx_points""")
def a9(t):
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = new_path(t.spark, f"points-{fmt}")
        tables.write_table(t.fx_points, path, fmt)
        reader = t.spark.read.schema(POINTS).format(fmt)
        back = (reader.option("header", "true") if fmt == "csv" else reader).load(path)
        part = back.agg(F.count(F.lit(1)).alias("rows"), F.sum("sl_no").alias("id_sum")).select(
            F.lit(fmt).alias("fmt"), "rows", "id_sum")
        out = part if out is None else out.unionByName(part)
    return out


@query("a10_to_geojson", "fx_points", """
SELECT sl_no, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(longitude AS VARCHAR) || ',' || CAST(latitude AS VARCHAR)
  || ']},"properties":{"sl_no":' || CAST(sl_no AS VARCHAR) || ',"district":' || CASE WHEN label = 1 THEN '"' || district || '"' ELSE 'null' END
  || '}}' AS value FROM fx_points""")
def a10(t):
    pts = t.fx_points.select("sl_no", F.when(F.col("label") == 1, F.col("district")).alias("district"), "latitude", "longitude")
    out = tables.to_geojson(pts)
    return out.select(F.get_json_object("value", "$.properties.sl_no").cast("bigint").alias("sl_no"), "value")


HEALTH = ("customer", "orders", "events", "supplier", "part")


def _health(t):
    paths = {n: f"{t.folder}/{n}.parquet" for n in HEALTH}
    return tables.dataset_health(t.spark, {**paths, "no_such_table": f"{t.folder}/no_such_table.parquet"})


@query("a11_dataset_health", "", " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, TRUE AS present, count(*) AS rows, NULL::VARCHAR AS error FROM {n}" for n in HEALTH)
    + " UNION ALL SELECT 'no_such_table', FALSE, 0, 'missing'")
def a11(t):
    return _health(t)


@query("a11_health_status", "", "SELECT 6::BIGINT AS datasets, 5::BIGINT AS present, CAST(sum(n) AS BIGINT) AS rows, 'degraded' AS status FROM ("
       + " UNION ALL ".join(f"SELECT count(*) AS n FROM {n}" for n in HEALTH) + ")")
def a11_status(t):
    return tables.health_status(_health(t))
