"""Fitted tree ensembles as rows, and scores by walking these rows.

A node is a row (tree, node, feature, threshold, left, right, gain, weight, value): rows
with ``x[feature] <= threshold`` go left; a leaf has feature -1. Forests of Spark ML and
the boosted trees of this package take the same form, so that one walk scores both and
one sum gives the importances. The number of nodes follows the settings of the fit (trees
and depth), not the data, so a table of nodes may go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from hazardspark.session import new_path

NODES = ("tree int, node int, feature int, threshold double, left int, right int, gain double, weight double, "
         "value double")
WALK_ROWS = 256  # rows that walk down all trees at once


def forest_nodes(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Nodes of the forest that ends a pipeline; the value of a leaf is its share of class 1.

    A split of a one-hot column names the values that go left; as a threshold it is one
    half, with the sides exchanged where the value 1 goes left.
    """
    path = new_path(spark, "forest")
    model.stages[-1].write().overwrite().save(path)
    stored = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    stats = F.col("impurityStats")
    weight = F.aggregate(stats, F.lit(0.0), lambda s, v: s + v)
    leaf = F.col("leftChild") < 0
    sides = F.col("split.leftCategoriesOrThreshold")
    hot = F.col("split.numCategories") >= 0
    turned = ~leaf & hot & F.array_contains(sides, F.lit(1.0))
    return stored.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(leaf, F.lit(-1)).otherwise(F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf & hot, F.lit(0.5)).when(~leaf, sides[0]).alias("threshold"),
        F.when(turned, F.col("rightChild")).otherwise(F.col("leftChild")).alias("left"),
        F.when(turned, F.col("leftChild")).otherwise(F.col("rightChild")).alias("right"),
        F.when(~leaf, F.col("gain")).alias("gain"), weight.alias("weight"), (stats[1] / weight).alias("value"))


class _Flat(NamedTuple):
    """All nodes as arrays; children are places in these arrays, a leaf is its own child."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def _flat(nodes: DataFrame) -> _Flat:
    table = nodes.select("tree", "node", "feature", "threshold", "left", "right", "value").toArrow()
    table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
    col = {c: np.array(table.column(c).fill_null(0)) for c in table.column_names}
    span = int(col["node"].max(initial=0)) + 1
    name = col["tree"].astype(np.int64) * span + col["node"]
    root = np.flatnonzero(np.append(True, col["tree"][1:] != col["tree"][:-1])) if len(name) else name
    inner = col["feature"] >= 0

    def place(child: str) -> np.ndarray:
        at = np.searchsorted(name, col["tree"].astype(np.int64) * span + col[child])
        return np.where(inner, at, np.arange(len(name))).astype(np.int32)

    return _Flat(root.astype(np.int32), np.maximum(col["feature"], 0), col["threshold"], place("left"), place("right"), col["value"])


def _walked(flat: _Flat, depth: int):
    """The leaves of each row of ``_x``, a column that gives way to theirs."""

    def leaves(x: pa.Array) -> pa.Array:
        known, trees = np.flatnonzero(np.array(x.is_valid())), len(flat.root)
        values = np.array(x.flatten(), float)
        width = len(values) // max(1, len(known))
        at = np.repeat(flat.root[:, None], len(known), axis=1)
        row = np.arange(len(known)) * width
        for _ in range(max(1, depth)):
            low = values[row + flat.feature[at]] <= flat.threshold[at]
            at = np.where(low, flat.left[at], flat.right[at])
        ends = np.zeros(len(x) + 1, np.int32)
        ends[known + 1] = trees
        return pa.ListArray.from_arrays(
            pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(flat.value[at].T.ravel()), mask=x.is_null())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, WALK_ROWS):
                batch = whole.slice(start, WALK_ROWS)
                x = batch.column("_x")
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], leaves(x)], [*batch.schema.names[:-1], "_x"])

    return run


def leaf_values(df: DataFrame, nodes: DataFrame, x: Column, depth: int, name: str = "leaves") -> DataFrame:
    """Add, per row, the value of the leaf of each tree (in the order of the trees) that ``x`` reaches."""
    ready = df.withColumn("_x", F.transform(x, lambda v: v.cast("double")))
    schema = StructType([*df.schema.fields, StructField("_x", ArrayType(DoubleType()))])
    return ready.mapInArrow(_walked(_flat(nodes), depth), schema).withColumnRenamed("_x", name)


def importances(nodes: DataFrame, names: list[str], per_tree: bool = True, weighted: bool = True) -> DataFrame:
    """feature, value of every name: shares of the gains of its splits, adding up to one.

    A forest weighs a gain with the rows of the node and lets each tree count once; for
    boosted trees (``per_tree`` and ``weighted`` off) it is the mean gain of a split.
    """
    inner = nodes.where("feature >= 0")
    gain = F.col("gain") * F.col("weight") if weighted else F.col("gain")
    if per_tree:
        trees = inner.groupBy("tree").agg(F.sum(gain).alias("_all"))
        parts = inner.join(trees, "tree").groupBy("feature").agg(F.sum(gain / F.col("_all")).alias("_v"))
    else:
        parts = inner.groupBy("feature").agg(F.avg(gain).alias("_v"))
    named = nodes.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    total = parts.agg(F.sum("_v")).scalar()
    return named.join(parts, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce(F.col("_v") / total, F.lit(0.0)).alias("value"))
