"""Mixing sources to target weights, in fixed-length blocks of words.

1. The words of each source form one stream: its documents in the order of an id
   hash, one after the other. The stream is packed into blocks of ``block`` words
   (the last may be shorter).
2. Each source has a target in words, and so a quota of block slots: whole passes
   over its blocks and part of a last pass.
3. Every output shard draws a multinomial count per source. Over all shards these
   sums miss the quotas by some noise, so the slots beyond a quota are handed to
   the sources that fell short.
4. The k-th slot of a source takes the block that a pseudorandom permutation of the
   pass gives for k, so a pass takes each block once at most.
5. Blocks are joined with the pieces of the documents by their index.

Nothing is cut or sampled away: a document's words are in the mix as often as its
blocks are drawn. What reaches the driver is one row per source, the mixing table
itself. Edge cases: a null text has no words and is never taken; a null source is a
source of its own, last in order; without any word nothing is drawn; repeated rows
are separate documents; equal ids are ordered by the hash of their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hazardspark.llm.common import SPACE, bucket_starts, slices
from hazardspark.session import materialize

WEIGHTS = (5, 2, 1)
BUCKETS = 1024  # parts of a source's stream that are ordered separately
BROADCAST_SOURCES = 100_000  # mixing tables up to this length are broadcast
_M64 = (1 << 64) - 1


@dataclass(frozen=True)
class Mix:
    """Settings of one mix: block length in words, blocks per output shard, seed."""

    block: int = 64
    shard_blocks: int = 1024
    seed: int = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Words wanted of each source, in source order.

    The sources share ``share`` times all words by weight; what a source would get
    beyond ``most`` times its size goes to the others, until none is above.
    """
    out = [0.0] * len(sizes)
    free = {i: weights[i % len(weights)] for i in range(len(sizes))}
    left = share * sum(sizes)
    while free:
        rate = left / sum(free.values())
        full = [i for i, w in free.items() if rate * w > most * sizes[i]]
        if not full:
            out = [rate * free[i] if i in free else t for i, t in enumerate(out)]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
            del free[i]
        left = max(left, 0.0)
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``index`` sent through a keyed permutation of 0..size-1, row by row.

    A four-round Feistel network over the next even number of bits; values beyond
    ``size`` walk on until they fall inside.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = x[todo] >> h, x[todo] & m
            for turn in range(4):
                z = right + k + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & _M64)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & m)
            x[todo] = (left << h) | right
            todo = todo[x[todo] >= size[todo].astype(np.uint64)]
    return x.astype(np.int64)


def _quota(target: float, size: int, blocks: int) -> int:
    """Slots that take about ``target`` words of ``size`` words in ``blocks`` blocks."""
    if not size:
        return 0
    passes = int(target // size)
    return passes * blocks + min(blocks, round((target - passes * size) / size * blocks))


class MixPlan:
    """The streams, targets and drawn slots of one mix.

    ``streams``: doc_id, text_hash, source, size, source_id, start (its first word in
    the source's stream), one row per document. ``slots``: shard, source_id, pass,
    block, one row per drawn block.
    """

    def __init__(self, docs: DataFrame, mix: Mix = Mix()):
        self.mix, self.spark = mix, docs.sparkSession
        sizes = docs.select(
            "doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count(F.col("text")).alias("size")
        )
        sizes = materialize(sizes, "mix-sizes")
        found = [(r["source"], r["size"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()]
        self.sources = sorted(found, key=lambda r: (r[0] is None, r[0] or ""))
        self.totals = [size for _, size in self.sources]
        self.targets = targets(self.totals)
        self.blocks = [-(-size // mix.block) for size in self.totals]
        self.quotas = [_quota(t, s, b) for t, s, b in zip(self.targets, self.totals, self.blocks)]
        self.streams = materialize(self._streams(sizes), "mix-streams")
        self.slots = self._slots()

    def source_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s, n, t) for i, ((s, n), t) in enumerate(zip(self.sources, self.targets))]
        out = spark.createDataFrame(rows, "source_id int, source string, source_size long, target double")
        return F.broadcast(out) if len(rows) <= BROADCAST_SOURCES else out

    def _streams(self, sizes: DataFrame) -> DataFrame:
        table = self.source_table(self.spark).select("source_id", F.col("source").alias("_source"))
        rows = sizes.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
        starts = bucket_starts(rows, ["source_id"], "bucket", {"before": F.col("size")})
        inside = (
            Window.partitionBy("source_id", "bucket").orderBy("doc_id", "text_hash")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        rows = rows.withColumn("here", F.sum("size").over(inside) - F.col("size"))
        return rows.join(starts, ["source_id", "bucket"]).select(
            "doc_id", "text_hash", "source", "size", "source_id", (F.col("before") + F.col("here")).alias("start")
        )

    def _slots(self) -> DataFrame:
        mix, total = self.mix, sum(self.quotas)
        shards = -(-total // mix.shard_blocks)
        share = np.array(self.quotas, float) / max(total, 1)
        n_sources = len(self.quotas)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column("shard").to_pylist():
                    size = min(mix.shard_blocks, total - shard * mix.shard_blocks)
                    rng = np.random.Generator(np.random.Philox(key=[mix.seed, shard]))
                    counts = rng.multinomial(size, share)
                    some = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), shard)), pa.array(some.astype(np.int32)), pa.array(counts[some])],
                        ["shard", "source_id", "n"],
                    )

        drawn = self.spark.range(shards).withColumnRenamed("id", "shard")
        drawn = drawn.mapInArrow(draw, "shard long, source_id int, n long")
        drawn = materialize(drawn.withColumn("bucket", F.col("shard") % F.lit(BUCKETS)), "mix-draws")
        sums = dict(drawn.groupBy("source_id").agg(F.sum("n")).collect())
        over = np.array([max(0, sums.get(i, 0) - q) for i, q in enumerate(self.quotas)], np.int64)
        short = np.array([max(0, q - sums.get(i, 0)) for i, q in enumerate(self.quotas)], np.int64)
        over_from, short_to = np.cumsum(over) - over, np.cumsum(short)

        # Rank of a shard's first slot among all slots of the source.
        starts = bucket_starts(drawn, ["source_id"], "bucket", {"before": F.col("n")})
        inside = (
            Window.partitionBy("source_id", "bucket").orderBy("shard")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        ranked = drawn.withColumn("here", F.sum("n").over(inside) - F.col("n"))
        ranked = ranked.join(starts, ["source_id", "bucket"])
        slots = ranked.select(
            "shard", "source_id",
            F.explode(F.sequence(F.col("before") + F.col("here"), F.col("before") + F.col("here") + F.col("n") - 1)).alias("k"),
        )
        quotas = np.array(self.quotas, np.int64)
        blocks = np.array(self.blocks, np.int64)
        names = ["" if s is None else f"={s}" for s, _ in self.sources]
        keys = np.array([xxhash.xxh64_intdigest(n.encode(), mix.seed) for n in names], np.uint64)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                source = batch.column("source_id").to_numpy().astype(np.int64)
                k = batch.column("k").to_numpy().copy()
                extra = k >= quotas[source]
                if extra.any():
                    number = over_from[source[extra]] + k[extra] - quotas[source[extra]]
                    heir = np.searchsorted(short_to, number, side="right")
                    # The heir's own draws are ranks 0..drawn-1; what it inherits follows them.
                    k[extra] = quotas[heir] - short[heir] + number - (short_to[heir] - short[heir])
                    source[extra] = heir
                turn, index = k // blocks[source], k % blocks[source]
                with np.errstate(over="ignore"):
                    key = keys[source] + turn.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("shard"), pa.array(source.astype(np.int32)), pa.array(turn.astype(np.int32)),
                     pa.array(permuted(index, blocks[source], key))],
                    ["shard", "source_id", "pass", "block"],
                )

        if not n_sources or not total:
            return self.spark.createDataFrame([], "shard long, source_id int, pass int, block long")
        return slots.mapInArrow(place, "shard long, source_id int, pass int, block long")

    def pieces(self) -> DataFrame:
        """Parts of documents by block: the stream's columns, block, first and last word (exclusive)."""
        length, end = self.mix.block, F.col("start") + F.col("size")
        blocks = F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length))
        parts = self.streams.where("size > 0").withColumn("block", F.explode(blocks))
        return parts.withColumns({
            "first": F.greatest(F.col("block") * length, F.col("start")) - F.col("start"),
            "last": F.least((F.col("block") + 1) * length, end) - F.col("start"),
        })

    def taken(self) -> DataFrame:
        """Every document with source_size, target and the words the mix takes of it."""
        # Sorted, not broadcast: their size is that of all blocks.
        times = self.slots.groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
        key = ["source_id", "doc_id", "start", "size"]
        sums = (
            self.pieces().join(times, ["source_id", "block"])
            .groupBy(*key).agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"))
        )
        sums = sums.select(*[F.col(c).alias(f"_{c}") for c in key], "taken")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        table = self.source_table(self.spark).select("source_id", "source_size", "target")
        return (
            self.streams.join(sums.hint("merge"), same, "left").join(table, "source_id")
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
        )

    def passes(self) -> DataFrame:
        """Per document and pass its drawn word ranges: doc_id, text_hash, copy (numbers
        equal documents), size, pass, parts (first, last; in order)."""
        # The optimizer would size the slots by the small table they are drawn from, and broadcast them.
        drawn = self.slots.select("source_id", "pass", "block").hint("merge")
        parts = self.pieces().join(drawn, ["source_id", "block"])
        rows = parts.groupBy("doc_id", "text_hash", "source_id", "start", "size", "pass").agg(
            F.array_sort(F.collect_list(F.struct("first", "last"))).alias("parts")
        )
        rows = rows.groupBy("doc_id", "text_hash", "source_id", "start", "size").agg(
            F.array_sort(F.collect_list(F.struct("pass", "parts"))).alias("passes")
        )
        order = Window.partitionBy("doc_id", "text_hash").orderBy("source_id", "start")
        return rows.withColumn("copy", F.row_number().over(order))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: str, parts: list[tuple[int, int]], size: int) -> str:
    """The words of ``parts``; a whole text stays as it is."""
    runs: list[list[int]] = []
    for first, last in parts:
        if runs and runs[-1][1] == first:
            runs[-1][1] = last
        else:
            runs.append([first, last])
    if runs == [[0, size]]:
        return text
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(data)]
    return b"\n".join(data[spans[a][0] : spans[b - 1][1]] for a, b in runs).decode("utf-8", "surrogatepass")


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as documents: one row per document and pass that takes words of it."""
    passes = materialize(MixPlan(docs, mix).passes(), "mix-passes")
    plan = passes.select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("copy").alias("_copy"), "size", "passes"
    )
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash"))
    if passes.agg(F.max("copy")).first()[0] not in (None, 1):
        order = Window.partitionBy("doc_id", "_text_hash").orderBy("source", "lang", "n_chars")
        rows = rows.withColumn("_number", F.row_number().over(order))
        same = same & (F.col("_number") == F.col("_copy"))
    taken = rows.join(plan.hint("merge"), same).select(*docs.columns, "size", F.explode("passes.parts").alias("parts"))
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = zip(
                batch.column("text").to_pylist(), batch.column("parts").to_pylist(), batch.column("size").to_pylist()
            )
            texts = [cut(t, [(p["first"], p["last"]) for p in parts], size) for t, parts, size in found]
            own = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names)

    return taken.mapInArrow(run, schema)
