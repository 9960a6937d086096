"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan of this package is written for.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Point joins can meet one very popular cell, tile or date; adaptive
    # execution splits such a partition even when that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A scan is estimated by its file's share, packed; the rows take many times that. Without the
    # factor millions of rows look small enough to be broadcast through the driver.
    "spark.sql.sources.fileCompressionFactor": "8.0",
}

BATCH_ROWS = 1024  # rows of texts sent to a Python worker at once

_written: dict[str, list[str]] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def short_batches(spark: SparkSession) -> None:
    """Send texts to Python workers some MB at a time: both sides hold whole batches off the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def session(app: str = "hazardspark", **conf: str) -> SparkSession:
    """Build (or get) a session; master, memory and folders stay with the caller."""
    builder = SparkSession.builder.appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of the session's warehouse, which executors
    share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, remembered for :func:`release`."""
    path = f"{shared_dir(spark)}/hazardspark/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives executor loss and lets later branches read only the
    columns they need.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def _file_system(spark: SparkSession, path: str):
    """Hadoop path and its file system; for names only, no data passes the driver."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.mkdirs(target)


def publish(spark: SparkSession, path: str, to: str) -> bool:
    """Move a finished folder below ``to`` in one step; False if there is none."""
    source, fs = _file_system(spark, path)
    if not fs.exists(source):
        return False
    make_folder(spark, to)
    return bool(fs.rename(source, _file_system(spark, f"{to}/{source.getName()}")[0]))


def _delete(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def discard(stored: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing will read again."""
    spark, path = stored.sparkSession, stored._stored_at
    _written.get(spark.sparkContext.applicationId, []).remove(path)
    _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables this session wrote."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
