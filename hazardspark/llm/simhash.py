"""Near-duplicates by SimHash, found through segment bit counts.

Each fingerprint is mapped to the bit counts of its segments. The Manhattan distance
of two such points is never more than the Hamming distance of the fingerprints, so a
range join of the points finds every link. The segments are cut into ``limit + 2``
blocks: points within Manhattan distance ``limit`` differ in at most ``limit``
blocks, so they agree on at least two, and share a grid cell named by these two
blocks and their counts. Candidates of a cell are kept if the Manhattan distance
allows it and then verified exactly.

A cell with more than ``crowd`` fingerprints is not joined with itself. Its members
take the exact way of common centres: all fingerprints around one 64-bit centre
(within half the limit) are linked to the smallest of them, which gives the same
components from a number of rows in proportion to the members.

Equal fingerprints are one point from the start, so copies cost one row. Edge cases:
a text without words (or null) has fingerprint zero and is linked like any other;
texts of fewer words than a shingle have one shingle, the whole sequence; a null id
takes part and never names a component unless all ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hazardspark.llm.common import connected, slices
from hazardspark.session import materialize

BITS = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PIECE = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over the word shingles of a whole text."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    n = max(1, len(found) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, PIECE):
        hashes = [digest(join(found[i : i + width]), seed) for i in range(start, min(n, start + PIECE))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t, width, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(values.view(np.int64))],
                ["doc_id", "text_hash", "fp"],
            )

    return run


def with_fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, fp (signed 64 bits) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprints(width, seed), "doc_id long, text_hash long, fp long")


def _segment(fp: Column, index: int, bits: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, index * bits).bitwiseAND(F.lit((1 << bits) - 1)))


def manhattan(a: Column, b: Column, segment_bits: int) -> Column:
    """Distance of the segment bit counts, a lower bound of the Hamming distance."""
    total = F.lit(0)
    for i in range(BITS // segment_bits):
        total = total + F.abs(_segment(a, i, segment_bits) - _segment(b, i, segment_bits))
    return total


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def grid_cells(points: DataFrame, limit: int, segment_bits: int) -> DataFrame:
    """One row per fingerprint and pair of blocks: the cell it lies in."""
    n, blocks = BITS // segment_bits, limit + 2
    bounds = [n * k // blocks for k in range(blocks + 1)]
    fp = F.col("fp")

    def coordinates(block: int) -> list[Column]:
        return [_segment(fp, i, segment_bits).cast("byte") for i in range(bounds[block], bounds[block + 1])]

    cells = [
        F.xxhash64(F.lit(k), *coordinates(one), *coordinates(two))
        for k, (one, two) in enumerate(combinations(range(blocks), 2))
    ]
    return points.select("fp", F.explode(F.array(*cells)).alias("cell"))


def _ball(fp: Column, radius: int) -> Column:
    """All 64-bit values within ``radius`` flipped bits, as an array."""
    masks = [0]
    for size in range(1, radius + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(BITS), size)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: m.bitwiseXOR(fp))


def centre_links(points: DataFrame, limit: int) -> DataFrame:
    """Links that join the same components as all links, for an even limit."""
    if limit % 2:
        raise ValueError("common centres need an even limit")
    balls = points.select("fp", F.explode(_ball(F.col("fp"), limit // 2)).alias("centre"))
    least = balls.groupBy("centre").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n"))
    shared = least.where("n > 1").select("centre", "low")
    return balls.join(shared, "centre").where("fp <> low").select("fp", F.col("low").alias("other"))


def links(points: DataFrame, limit: int = 2, segment_bits: int = 2, crowd: int = 256) -> DataFrame:
    """Linked distinct fingerprints (``fp``, ``other``): every link of sparse cells,
    and links with the same components for the members of crowded ones."""
    cells = grid_cells(points, limit, segment_bits)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes, "simhash-cells")
    sparse = cells.join(sizes.where(F.col("n") <= crowd).select("cell"), "cell")
    sparse = materialize(sparse, "simhash-members")
    other = sparse.select("cell", F.col("fp").alias("other"))
    fp, to = F.col("fp"), F.col("other")
    found = (
        sparse.join(other, "cell").where(fp < to)
        .where(manhattan(fp, to, segment_bits) <= limit)
        .where(hamming(fp, to) <= limit)
        .select("fp", "other")
    )
    crowded = sizes.where(F.col("n") > crowd).select("cell")
    if crowded.isEmpty():
        return found.distinct()
    dense = cells.join(crowded, "cell").select("fp").distinct()
    return found.unionByName(centre_links(dense, limit)).distinct()


def components(prints: DataFrame, limit: int = 2, segment_bits: int = 2, crowd: int = 256) -> DataFrame:
    """Per distinct fingerprint: ``fp``, ``component_id`` (smallest id reachable) and
    ``keeper`` (id and text hash of the row that stands for the component)."""
    points = prints.groupBy("fp").agg(
        F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("row")
    )
    points = materialize(points, "simhash-points")
    roots = connected(links(points.select("fp"), limit, segment_bits, crowd), "fp", "other", "simhash-stars", materialize)
    rooted = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    ends = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.min("row").alias("keeper"))
    return rooted.select("fp", "root").join(ends, "root").select("fp", "component_id", "keeper")


def near_duplicates(docs: DataFrame, limit: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = materialize(with_fingerprints(docs), "simhash")
    classes = components(prints, limit).select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, limit: int = 2) -> DataFrame:
    """One document of each component: its smallest id (repeated rows: one of them)."""
    prints = materialize(with_fingerprints(docs), "simhash")
    return rows_of(docs, components(prints, limit))


def rows_of(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The rows that the ``keeper`` (id, text hash) of some component names, once each."""
    keepers = components.select("keeper.doc_id", "keeper.text_hash").distinct()
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    kept = keyed.join(
        keepers.select(F.col("doc_id").alias("_keeper"), F.col("text_hash").alias("_text_hash2")),
        F.col("doc_id").cast("long").eqNullSafe(F.col("_keeper")) & (F.col("_text_hash") == F.col("_text_hash2")),
        "left_semi",
    )
    return kept.dropDuplicates(["doc_id", "_text_hash"]).select(*docs.columns)
