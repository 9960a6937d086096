"""Total orders without a single-partition sort.

Spark's window without ``partitionBy`` moves every row into one task. The
functions here range-partition on the order columns, write the ranges once
(range bounds are sampled, so they must not be drawn a second time), sum up each
range and add the totals of the ranges before it. Only one row per range is ever
gathered, and the number of ranges is the number of shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardspark.session import materialize

_RANGE = "_range"
_LOCAL = "_local"
_LOCAL_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_position(df: DataFrame, order: list, name: str = "position", start: int = 0) -> DataFrame:
    """Add consecutive numbers in the given order.

    The order columns should be unique together: ties cannot be split between
    ranges and their numbers would be arbitrary.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (
        df.repartitionByRange(_parts(df), *cols)
        .sortWithinPartitions(*cols)
        .withColumn(_LOCAL, F.monotonically_increasing_id())
        .withColumn(_RANGE, F.spark_partition_id())
        .withColumn(_LOCAL, F.col(_LOCAL).bitwiseAND(F.lit(_LOCAL_BITS)))
    )
    stored = materialize(ranged, "ordered")
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(_RANGE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(_RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        stored.join(F.broadcast(offsets), _RANGE)
        .withColumn(name, F.col("_offset") + F.col(_LOCAL) + F.lit(start))
        .drop(_RANGE, _LOCAL, "_offset")
    )


def running_totals(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums (``name -> value``) in the given total order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(_parts(df), *cols).withColumn(_RANGE, F.spark_partition_id())
    stored = materialize(ranged, "ranged")
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy(_RANGE).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    offsets = totals.select(
        _RANGE,
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
    )
    inside = (
        Window.partitionBy(_RANGE).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = stored.join(F.broadcast(offsets), _RANGE)
    out = out.withColumns({k: F.col(f"_o_{k}") + F.sum(v).over(inside) for k, v in sums.items()})
    return out.drop(_RANGE, *[f"_o_{k}" for k in sums])


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in ``order``.

    The rank filter is pushed below the shuffle (WindowGroupLimit), so a task
    sends one row per key however popular the key is.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int, name: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= n)


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row reports as one row, by scalar subqueries rather than a join."""
    for i, other in enumerate(others):
        first = first.withColumn(f"_report{i}", other.select(F.struct(*other.columns)).scalar())
    plain = [c for c in first.columns if not c.startswith("_report")]
    return first.select(*plain, *[f"_report{i}.*" for i in range(len(others))])
