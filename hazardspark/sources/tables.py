"""Row tables: CSV, JSON and GeoJSON in and out."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hazardspark.functions.numeric import nan_to_null


class MissingTable(FileNotFoundError):
    """The path does not exist."""


class EmptyTable(ValueError):
    """The path exists and holds no rows."""


def _missing(error: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(error)


def nan_columns_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floats}) if floats else df


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, allow_empty: bool = False,
               multi_line: bool = False, malformed: str = "FAILFAST") -> DataFrame:
    """Headered CSV with an explicit schema; NaN becomes NULL.

    A row that does not fit the schema is an error, never a row of NULLs. Text with
    line breaks needs ``multi_line``, which reads each file in one task.
    """
    try:
        df = spark.read.schema(schema).csv(path, header=True, nanValue="NaN", multiLine=multi_line, escape='"', mode=malformed)
    except AnalysisException as error:
        if _missing(error):
            raise MissingTable(path) from error
        raise
    df = nan_columns_to_null(df)
    if not allow_empty and df.isEmpty():
        raise EmptyTable(path)
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: list[str] | None = None) -> None:
    """Write parquet, CSV with header, or JSON lines."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, escape='"')
    elif fmt in ("parquet", "json", "orc"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def to_geojson(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One GeoJSON Feature per row in column ``value``; missing properties are null."""
    props = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (lat, lon)])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
        props.alias("properties"),
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def read_features(spark: SparkSession, path: str, properties: T.StructType | str, lines: bool = True) -> DataFrame:
    """GeoJSON points to rows.

    ``lines=True`` reads one Feature per line and splits freely. A classic
    FeatureCollection (``lines=False``) is one JSON value, so one task parses
    each file.
    """
    if isinstance(properties, str):
        properties = T.StructType.fromDDL(properties)
    geometry = T.StructType([T.StructField("type", T.StringType()),
                             T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
    feature = T.StructType([T.StructField("geometry", geometry), T.StructField("properties", properties)])
    try:
        if lines:
            rows = spark.read.schema(feature).json(path).select(F.struct("geometry", "properties").alias("f"))
        else:
            whole = T.StructType([T.StructField("features", T.ArrayType(feature))])
            rows = spark.read.schema(whole).json(path, multiLine=True).select(F.explode("features").alias("f"))
    except AnalysisException as error:
        if _missing(error):
            raise MissingTable(path) from error
        raise
    return rows.select(
        F.col("f.geometry.coordinates")[1].alias("latitude"),
        F.col("f.geometry.coordinates")[0].alias("longitude"),
        *[F.col(f"f.properties.`{p.name}`") for p in properties.fields],
    )


def merge_fragments(rows: DataFrame, markers: tuple[str, ...] = ("sl.no", "slide_no")) -> DataFrame:
    """Table fragments (``fragment, row_no, cells array<string>``) to one table.

    The first row of a fragment is its header if any cell holds a marker;
    otherwise its columns are named by position. Fragments of a single row are
    dropped. Columns are aligned by name, absent ones are NULL.
    """
    def flat(cell):
        return F.regexp_replace(F.trim(F.coalesce(cell, F.lit("None"))), "\n", " ")

    heads = rows.where(F.col("row_no") == 0).select("fragment", F.transform("cells", flat).alias("_head"))
    is_header = F.exists("_head", lambda h: reduce(lambda a, b: a | b, [F.lower(h).contains(m) for m in markers]))
    by_position = F.transform(F.sequence(F.lit(0), F.size("_head") - 1), lambda i: i.cast("string"))
    heads = heads.select(
        "fragment", is_header.alias("_named"), F.when(is_header, F.col("_head")).otherwise(by_position).alias("_names"))
    sized = rows.groupBy("fragment").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= 2)
    heads = heads.join(sized, "fragment")
    # Column names are the output schema, so their distinct list is small by nature.
    names = [r[0] for r in heads.select(F.explode("_names").alias("n")).distinct().sort("n").collect()]
    body = rows.join(heads, "fragment").where(~F.col("_named") | (F.col("row_no") > 0))
    # Short rows are padded with NULL, cells beyond the header have no column.
    cells = F.filter(F.arrays_zip("_names", "cells"), lambda c: c["_names"].isNotNull())
    filled = body.withColumn("_map", F.map_from_entries(cells))
    return filled.select("fragment", "row_no", *[F.try_element_at("_map", F.lit(n)).alias(n) for n in names])


def merge_frames(frames: list[DataFrame]) -> DataFrame:
    """Concatenate tables that already have headers, aligned by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes per extension; file contents are never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    )
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def _row_count(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One row ``n``. Parquet is read without a column, so only its footers are opened and no schema is inferred."""
    reader = spark.read.format(fmt)
    if fmt == "parquet":
        reader = reader.schema(T.StructType([]))
    elif fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(path).agg(F.count(F.lit(1)).alias("n"))


def dataset_health(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """Present flag, row count and error per dataset.

    All data sets are counted in one job. Only if a file cannot be read are they
    counted one by one: it is that data set's error, not the report's.
    """
    counts, found = {}, {}
    for name, path in paths.items():
        try:
            counts[name] = _row_count(spark, path, fmt).select(F.lit(name).alias("dataset"), "n")
        except (PySparkException, Py4JJavaError) as error:
            missing = _missing(error)
            found[name] = (name, not missing, 0, "missing" if missing else "unreadable")
    together = [reduce(DataFrame.unionByName, counts.values())] if counts else []
    try:
        rows = [row for df in together for row in df.collect()]
    except (PySparkException, Py4JJavaError):
        rows = []
        for name, df in counts.items():
            try:
                rows += df.collect()
            except (PySparkException, Py4JJavaError):
                found[name] = (name, True, 0, "unreadable")
    found.update({row.dataset: (row.dataset, True, row.n, None) for row in rows})
    ddl = "dataset string, present boolean, rows bigint, error string"
    return spark.createDataFrame([found[name] for name in paths], ddl)


def health_status(health: DataFrame) -> DataFrame:
    ok = F.bool_and(F.col("present") & (F.col("rows") > 0))
    return health.agg(
        F.count(F.lit(1)).alias("datasets"), F.count_if(F.col("present")).alias("present"),
        F.sum("rows").alias("rows"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("degraded")).alias("status"))
