"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard gives a key its own score from a hash of both, scaled by the shard's
weight, and the best score wins. A further shard can only win keys for itself, so no
row moves between the shards that were there. Built-in functions only.

Edge cases: a null key counts as the word ``null``; a null text has size 1 and the
checksum of the empty text; repeated rows share a shard and get slots of their own;
rows with equal ids are ordered by size and checksum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardspark.llm.common import bucket_starts
from hazardspark.session import materialize

_UNIT = 1 << 52  # the first 13 hex digits of a digest are exact in a double


def score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for a uniform u of key and shard: the smallest wins, and shard
    k wins with probability weight_k / sum of weights."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{shard}")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(_UNIT))
    return -F.log(u) / F.lit(float(weight))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the winning shard; shards of weight 0 never win."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    entries = [
        F.struct(score(key, k, w).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0
    ]
    if not entries:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*entries))["shard"]


def number_slots(rows: DataFrame, key: str, ties: Sequence[str], slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 inside each shard, in the order of ``key`` and ``ties``.

    The rows are dealt into key ranges and written (so that the sampled bounds hold),
    counted per shard and range, and numbered inside these pieces: no task sees a
    whole shard.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key, *ties).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "shard-ranges")
    starts = bucket_starts(ranged, ["shard"], "_range", {"_before": F.lit(1)})
    inside = F.row_number().over(Window.partitionBy("shard", "_range").orderBy(key, *ties))
    return (
        ranged.withColumn("_inside", inside).join(starts, ["shard", "_range"])
        .withColumn(slot, F.col("_before") + F.col("_inside") - 1)
        .drop("_range", "_before", "_inside")
    )


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, for ``grown`` weights, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        (shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return number_slots(materialize(rows, "shards"), "doc_id", ["size", "text_crc32"])
