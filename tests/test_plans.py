"""Plan shapes that matter at scale."""

import pytest
from pyspark.sql import functions as F

from hazardspark.operators import ordering, rainfall, spatial, terrain
from hazardspark.params import Box, GridMeta
from hazardspark.session import new_path
from hazardspark.sources import raster


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    before = {}

    def set_(**kw):
        for key, value in kw.items():
            key = "spark.sql." + key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    text = plan(ordering.first_per_key(df, ["k"], ["id"]))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_popular_cell_is_split(spark, conf):
    """A third of the points fall into one cell; adaptive execution splits its join partition."""
    conf(autoBroadcastJoinThreshold="-1", adaptive__skewJoin__skewedPartitionThresholdInBytes="200KB",
         adaptive__skewJoin__skewedPartitionFactor="2.0", adaptive__advisoryPartitionSizeInBytes="100KB")
    cells = spark.range(10000).select((F.col("id") / 100).cast("int").alias("r"), (F.col("id") % 100).cast("int").alias("c"),
                                      F.col("id").cast("double").alias("z"))
    n = F.when(F.col("id") % 3 == 0, F.lit(4242)).otherwise(F.col("id") * 7919 % 10000)
    pts = spark.range(0, 300000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"),
                                              (F.lit(99.5) - F.floor(n / 100)).alias("latitude"), (n % 100 + 0.5).alias("longitude"))
    out = spatial.sample_containing(pts, cells, GridMeta(0.0, 100.0, 1.0, 1.0, 100, 100), ["z"])
    totals = out.agg(F.count("z").alias("n"), F.count_if(F.col("z") == 4242.0).alias("hot"), F.max("name"))
    row = totals.first()
    assert row.n == 300000 and row.hot >= 100000
    totals.collect()
    assert "skew=true" in plan(totals)


def test_numbering_never_gathers_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    text = plan(ordering.with_position(df, ["k"]))
    # the only single-partition exchange is the one of the range totals
    assert text.count("SinglePartition") == 1 and "BroadcastHashJoin" in text


def test_stencil_shuffles_once(spark):
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"),
                                    F.rand(1).alias("z"))
    text = plan(terrain.derivatives(cells, GridMeta(88.0, 27.5, 0.01, 0.01, 20, 20)))
    assert text.count("Exchange") == 1


def test_window_bounds_reach_the_scan_and_columns_are_pruned(spark):
    path = new_path(spark, "points")
    spark.range(100).select("id", F.lit(27.2).alias("latitude"), F.lit(88.5).alias("longitude"), F.lit("x").alias("junk")).write.parquet(path)
    df = raster.window_read(spark.read.parquet(path), Box(27.0, 27.1, 88.0, 88.1)).select("id")
    text = plan(df)
    assert "GreaterThanOrEqual(latitude,27.0)" in text and "junk" not in text


def test_month_scan_prunes_partitions(spark):
    path = new_path(spark, "daily")
    daily = spark.range(400).select((F.col("id") % 5).alias("cell_id"), F.date_add(F.lit("2012-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    raster.write_daily(daily.withColumns({"year": F.year("d"), "month": F.month("d")}), path)
    months = spark.createDataFrame([(2012, 6), (2012, 7)], "year int, month int").where("month < 7")
    df = raster.month_scan(spark.read.parquet(path), months)
    assert df.count() == 30
    assert "dynamicpruning" in plan(df)


def test_lookback_joins_on_keys(spark):
    day = F.date_add(F.lit("2012-01-01").cast("date"), F.col("id").cast("int"))
    daily = spark.range(100).select((F.col("id") % 2).alias("cell_id"), day.alias("d"), F.rand(1).alias("precip"))
    events = spark.range(50).select("id", (F.col("id") % 2).alias("cell_id"), day.alias("event_date"))
    text = plan(rainfall.antecedent_at(events, daily))
    assert "NestedLoop" not in text and "Cartesian" not in text


GRID = GridMeta(0.0, 64.0, 1.0, 1.0, 64, 64)


def grid_cells(spark):
    return spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("r"), (F.col("id") % 64).cast("int").alias("c"),
                                       F.when(F.col("id") % 11 > 0, F.col("id").cast("double")).otherwise(-9999.0).alias("z"))


def test_tiles_without_points_are_not_opened(spark):
    path = new_path(spark, "tiles")
    tiles = raster.store_tiles(grid_cells(spark), GRID, path, 16)
    assert sorted(r.tile for r in tiles.select("tile").distinct().collect()) == list(range(16))
    places = [(1, 63.5, 0.5), (2, 60.5, 5.5), (3, 60.5, 5.5), (4, 10.5, 50.5), (5, 99.0, 1.0), (6, None, 3.0), (7, float("nan"), 3.0)]
    pts = spark.createDataFrame(places, "id long, latitude double, longitude double")
    got = spatial.stack_tiles(pts, tiles, GRID, {"z": -9999.0}, 16)
    want = spatial.stack_layers(pts, grid_cells(spark), GRID, {"z": -9999.0})
    for bad in range(16):  # tiles 0 and 15 hold the points; the others cannot be read any more
        if bad not in (0, 15):
            spark.createDataFrame([("junk",)], "r string").write.mode("overwrite").parquet(f"{path}/tile={bad}")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0])[:5] == sorted(map(tuple, want.collect()), key=lambda r: r[0])[:5]
    assert got.where("z is null").count() == 4 and "dynamicpruning" in plan(got)
    with pytest.raises(Exception):
        tiles.agg(F.sum("r")).collect()


def test_no_points_and_no_cells(spark):
    none = spark.createDataFrame([], "id long, latitude double, longitude double")
    tiles = raster.store_tiles(grid_cells(spark).limit(0), GRID, new_path(spark, "tiles"), 16)
    assert spatial.stack_tiles(none, tiles, GRID, {"z": None}, 16).count() == 0
    pts = spark.createDataFrame([(1, 63.5, 0.5)], none.schema)
    assert [tuple(r) for r in spatial.stack_tiles(pts, tiles, GRID, {"z": None}, 16).collect()] == [(1, 63.5, 0.5, None)]


def rows_scanned(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_window_reads_few_rows_of_clustered_storage(spark, conf):
    """A box of one per cent of the area reads under ten per cent of the rows; a third share one place."""
    conf(adaptive__coalescePartitions__enabled="false")  # one file per task
    path, plain = new_path(spark, "curve"), new_path(spark, "plain")
    hot = F.col("id") % 3 == 0
    pts = spark.range(0, 120000, 1, 4).select(
        "id", F.when(hot, 0.9).otherwise(F.col("id") * 7919 % 10007 / 10007).alias("latitude"),
        F.when(hot, 0.1).otherwise(F.col("id") * 104729 % 10009 / 10009).alias("longitude"))
    pts = pts.unionByName(spark.createDataFrame([(-1, None, 0.5), (-2, float("nan"), 0.5), (-3, 7.0, 7.0)], pts.schema))
    pts.write.parquet(plain)
    raster.write_clustered(pts, path, Box(0.0, 1.0, 0.0, 1.0), page_rows=500)
    box = Box(0.40, 0.50, 0.40, 0.50)
    few, all_ = (raster.window_read(spark.read.parquet(p), box) for p in (path, plain))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, all_.collect())) and few.count() > 500
    assert rows_scanned(few) < 12000 < rows_scanned(all_)
    assert spark.read.parquet(path).count() == 120003
    per_file = spark.read.parquet(path).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per_file < 25000  # the 40,000 rows of the popular place are not one task


def test_rows_of_a_packed_file_are_not_broadcast(spark, tmp_path):
    """A million rows in a file below the broadcast threshold are shuffled, a short table is not."""
    spark.range(1_000_000).coalesce(1).write.parquet(f"{tmp_path}/many")
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/few")
    many, few = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("many", "few"))
    size = sum(p.stat().st_size for p in (tmp_path / "many").glob("*.parquet"))
    assert 2 << 20 < size < 10 << 20
    wide = many.withColumns({c: F.col("id") % 7 for c in "abcd"})
    assert "BroadcastHashJoin" not in plan(wide.join(many.withColumn("z", F.col("id")), "id"))
    assert "BroadcastHashJoin" in plan(wide.join(few, "id"))
