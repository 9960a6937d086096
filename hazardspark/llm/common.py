"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# White space between words, as a class body for Java patterns: space, tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def words(text: Column) -> Column:
    """Words of a text as an array (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def count_matches(text: Column, keep: str) -> Column:
    """Characters of ``text`` inside the class body ``keep`` (null text: 0)."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{keep}]+", ""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def id_remainder(column: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (null id: null)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % F.lit(divisor)


def give_back() -> None:
    """Return freed memory of this process to the system. A worker serves the tasks of many
    stages and would else keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that a worker holds few texts as Python objects."""
    give_back()
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)
    batch = None
    give_back()


def least_hashes(rows: DataFrame, group: str, hash_col: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the smallest 64-bit hash.

    Only rows below a bound that about 2n + 50 of a group pass are ranked, so the
    ranking sees so many of a group, however large it is. ``rows`` is read twice; the
    counts on the driver are one row per group, which must be few.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1))).collect()
    place = F.col(hash_col).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    bound = F.lit(1.0)
    for value, count in counts:
        bound = F.when(F.col(group) == F.lit(value), F.lit((2 * n + 50) / count)).otherwise(bound)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hash_col))
    return rows.where(place < bound).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain_columns(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, whatever else the table carries."""
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def bucket_starts(df: DataFrame, keys: list[str], bucket: str, sums: dict[str, Column]) -> DataFrame:
    """Per key and bucket, the totals of the key's earlier buckets.

    The rows are summed up before they are shuffled; the window sees one row per
    key and bucket, so a key with a third of all rows costs as much as any other.
    """
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, bucket, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums]
    )


def _are_stars(pairs: DataFrame) -> bool:
    """True if every ``a`` has one ``b`` and no ``b`` has a smaller one. Partial sums go first, one number comes back."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    between = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
    return between.agg(F.count(F.lit(1))).first()[0] == 0


def connected(edges: DataFrame, left: str, right: str, label: str, keep) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge table.

    Alternates large and small stars until all edges lead to the smallest node, so a
    chain of n nodes takes about log n rounds. Every round groups with partial sums and
    joins back (no window over a node's neighbours), and is written with
    ``keep(df, label)``. Self edges are allowed; nodes without any edge are absent.
    Returns columns ``node`` and ``root``.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    # Each edge runs from its larger to its smaller end.
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = keep(pairs, label)
    while not _are_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = keep(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        pairs = keep(small, label)
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
