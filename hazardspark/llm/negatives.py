"""Hard negatives by inner product search over length buckets with sorted coordinate lists.

For each anchor, the rows of its own label with the highest scores are its positives;
its hard negatives for a positive are the highest-scored rows of other labels whose
score lies between a share of the positive's score and that score.

1. All rows are numbered by falling vector length and cut into buckets of at most
   ``BUCKET`` rows. A bucket keeps its vectors and, for every coordinate, the list of
   its rows sorted by their value in the vector of length one.
2. A score of at least t means a cosine of at least ``t / (|anchor| * longest)`` in a
   bucket: buckets that are too short are not visited. In the others the largest
   coordinates of the anchor bound the values a partner can have there; the shortest of
   these runs of the sorted lists is cut with the others, and what is left is scored.
3. Every anchor first visits about the square root of the number of buckets (chosen by
   a hash, so no bucket is everybody's first). What it finds there bounds its search of
   the others. Rows sent on per anchor so grow with that root, not with the buckets.

All buckets that can hold an answer are visited, so the result is exact: bounds are
widened by far more than the rounding of doubles, scores are integer sums.

Edge cases: rows with a null label, a null vector or a null or non-finite component take
no part; missing components of a shorter vector count as zero, so an empty vector scores
zero; rows are told apart by position, so a repeated row is another row of its own;
a null id is never an anchor and comes last in ties; negative positives have no
negatives; an empty table gives no rows; other columns are ignored. A score must fit a
long: a vector whose squared length does not raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hazardspark.operators.ordering import top_per_key, with_position
from hazardspark.session import materialize

BUCKET = 1 << 15  # rows of a bucket at most; their numbers in the lists take two bytes
_LEAST = 1 << 10  # a small table is cut into smaller buckets, for the sake of its tasks
_SPLIT = 16
FOCUS = 4  # coordinates of an anchor looked up in the sorted lists
_SLACK = 1e-9
_EXACT = float(1 << 53)  # integer sums below are exact in doubles
_NO_ID = np.iinfo(np.int64).max

_INDEX = (
    "bucket long, longest double, ids binary, no_id binary, labels binary, vectors binary, width int, bytes int, "
    "lists binary"
)


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")))


def _index(table: pa.Table) -> pa.Table:
    """The rows of a bucket as one row: vectors, and row numbers sorted per coordinate."""
    table = table.sort_by("no")
    n = table.num_rows
    parts = [np.asarray(v, np.int64) for v in table.column("vector").to_pylist()]
    width = max(len(p) for p in parts)
    vectors = np.zeros((n, width), np.int64)
    for row, part in zip(vectors, parts):
        row[: len(part)] = part
    norms = np.array(table.column("norm"))
    lists = np.argsort(_units(vectors, norms), axis=0, kind="stable").T.astype("<u2")
    peak = int(np.abs(vectors).max(initial=0))
    size = next(b for b in (1, 2, 4, 8) if peak < 1 << (8 * b - 1))
    ids = table.column("vec_id")
    columns = [
        table.column("bucket")[0].as_py(), float(norms.max()),
        np.array(ids.fill_null(_NO_ID), "<i8").tobytes(), np.array(ids.is_null()).tobytes(),
        np.array(table.column("label"), "<i8").tobytes(), vectors.astype(f"<i{size}").tobytes(), width, size,
        np.ascontiguousarray(lists).tobytes(),
    ]
    types = [pa.int64(), pa.float64(), *[pa.binary()] * 4, pa.int32(), pa.int32(), pa.binary()]
    names = [field.split()[0] for field in _INDEX.split(", ")]
    return pa.table([pa.array([c], t) for c, t in zip(columns, types)], names=names)


def _units(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return vectors / np.where(norms > 0, norms, 1.0)[:, None]


class Bucket:
    """One bucket as its task sees it."""

    def __init__(self, row: dict, size: int):
        self.longest, self.first = row["longest"], row["bucket"] * size
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.no_id = np.frombuffer(row["no_id"], bool)
        self.labels = np.frombuffer(row["labels"], "<i8")
        n, self.width = len(self.ids), row["width"]
        self.vectors = np.frombuffer(row["vectors"], f"<i{row['bytes']}").reshape(n, self.width).astype(np.int64)
        self.wide = self.vectors.astype(float)
        self.units = _units(self.vectors, np.sqrt((self.wide**2).sum(axis=1)))
        self.lists = np.frombuffer(row["lists"], "<u2").reshape(self.width, n)
        self.sorted = {}

    def _run(self, coordinate: int, low: float, high: float) -> np.ndarray:
        """Rows whose value of a coordinate is feasible, a run of its sorted list."""
        if coordinate not in self.sorted:
            self.sorted[coordinate] = self.units[self.lists[coordinate], coordinate]
        values = self.sorted[coordinate]
        a, b = np.searchsorted(values, low), np.searchsorted(values, high, side="right")
        return self.lists[coordinate][a:b]

    def feasible(self, anchors: np.ndarray, norms: np.ndarray, least: np.ndarray) -> list[np.ndarray | None]:
        """Per anchor the rows that may score at least ``least`` (None: all of them)."""
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where(least > 0, least / (norms * self.longest), -1.0) - _SLACK
        out: list[np.ndarray | None] = [None] * len(anchors)
        q = anchors / np.where(norms > 0, norms, 1.0)[:, None]
        if not self.width:
            return out
        focus = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :FOCUS]
        value, t = np.take_along_axis(q, focus, axis=1), np.clip(cosine, -1, 1)[:, None]
        spread = np.sqrt(np.clip((1 - value**2) * (1 - t**2), 0, None)) + _SLACK
        low = np.where(value >= -t, value * t - spread, -1 - _SLACK)
        high = np.where(value <= t, value * t + spread, 1 + _SLACK)
        for i in np.flatnonzero(cosine > -1):
            if cosine[i] > 1:
                out[i] = np.zeros(0, np.int64)
                continue
            runs = [self._run(f, a, b) for f, a, b in zip(focus[i], low[i], high[i])]
            rows = min(runs, key=len)
            if len(rows) * 2 > len(self.ids):
                continue  # scoring them all in one product is cheaper than cutting the runs
            values = self.units[np.ix_(rows, focus[i])]
            out[i] = rows[((values >= low[i]) & (values <= high[i])).all(axis=1)]
        return out

    def scores(self, anchors: np.ndarray, norms: np.ndarray, least: np.ndarray):
        """Per anchor its rows and their exact scores."""
        rows = self.feasible(anchors, norms, least)
        exact = float(norms.max(initial=0)) * self.longest < _EXACT
        left, right = (anchors.astype(float), self.wide) if exact else (anchors, self.vectors)
        whole = [i for i, r in enumerate(rows) if r is None]
        products = dict(zip(whole, left[whole] @ right.T)) if whole else {}
        every = np.arange(len(self.ids))
        for i, some in enumerate(rows):
            found = products[i] if some is None else right[some] @ left[i]
            yield i, every if some is None else some.astype(np.int64), found.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Places of the ``n`` highest scores; ties by id, null ids last."""
        places = np.arange(len(rows))
        if len(rows) > n:
            places = np.flatnonzero(scores >= np.partition(scores, len(rows) - n)[len(rows) - n])
        at = rows[places]
        return places[np.lexsort((self.ids[at], self.no_id[at], -scores[places]))][:n]


_FOUND = "no long, bound long, score long, vec_id long"


def _search(pick: Callable, size: int):
    """Task code: a bucket's row comes first, then the anchors that visit it, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number = None, None
        for batch in batches:
            ends = np.array(batch.column("bucket"))
            starts = np.flatnonzero(np.append(True, ends[1:] != ends[:-1])) if len(ends) else []
            for a, b in zip(starts, [*starts[1:], len(ends)]):
                part, visits = batch.slice(a, b - a), batch.slice(a, b - a)
                if part.column("no")[0].as_py() is None:
                    bucket, number = Bucket(part.slice(0, 1).to_pylist()[0], size), ends[a]
                    visits = part.slice(1)
                if bucket is None or number != ends[a]:
                    raise ValueError("a bucket is missing")
                for start in range(0, visits.num_rows, 512):
                    yield from _visit(bucket, visits.slice(start, 512), pick)

    return run


def _visit(bucket: Bucket, visits: pa.RecordBatch, pick: Callable) -> Iterator[pa.RecordBatch]:
    rows = visits.select(["no", "label", "vector", "norm", "least", "bounds", "floors"]).to_pylist()
    anchors = np.zeros((len(rows), bucket.width), np.int64)
    for line, row in zip(anchors, rows):
        part = row["vector"][: bucket.width]
        line[: len(part)] = part
    norms = np.array([r["norm"] for r in rows])
    least = np.array([-np.inf if r["least"] is None else float(r["least"]) for r in rows])
    out = [[], [], [], []]
    for i, at, scores in bucket.scores(anchors, norms, least):
        row = rows[i]
        other = at + bucket.first != row["no"]
        for bound, places in pick(bucket, row, at, scores, other):
            out[0] += [row["no"]] * len(places)
            out[1] += [bound] * len(places)
            out[2] += scores[places].tolist()
            out[3] += [None if bucket.no_id[k] else int(bucket.ids[k]) for k in at[places]]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["no", "bound", "score", "vec_id"])


def _pick_positives(n: int):
    def pick(bucket: Bucket, row: dict, at, scores, other):
        keep = other & (bucket.labels[at] == row["label"])
        if row["least"] is not None:
            keep &= scores >= row["least"]
        places = np.flatnonzero(keep)
        yield None, places[bucket.best(at[places], scores[places], n)]

    return pick


def _pick_negatives(n: int):
    def pick(bucket: Bucket, row: dict, at, scores, other):
        differs = bucket.labels[at] != row["label"]
        for bound, floor in zip(row["bounds"], row["floors"]):
            places = np.flatnonzero(differs & (scores >= floor) & (scores <= bound))
            yield bound, places[bucket.best(at[places], scores[places], n)]

    return pick


class HardNegatives:
    """Index over ``rows`` (vec_id, label, vector as array<long>) and searches in it."""

    def __init__(self, rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5,
                 share: tuple[int, int] = (80, 100)):
        self.positives, self.negatives, self.share = positives, negatives, share
        square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        rows = rows.where("label is not null and vector is not null").select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector",
            F.sqrt(square).alias("norm"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        )
        # The hash spreads vectors of one length over the ranges that the numbering deals out.
        order = [F.col("norm").desc(), F.xxhash64("vec_id", "vector"), F.col("vec_id"), F.col("label")]
        rows = materialize(with_position(rows, order, "no"), "negatives-rows")
        count, longest = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
        if (longest or 0.0) >= 2.0**31:
            raise ValueError("scores of these vectors do not fit a long")
        self.size = min(BUCKET, max(_LEAST, count // _SPLIT))
        self.buckets = max(1, -(-count // self.size))
        bucketed = rows.withColumn("bucket", F.floor(F.col("no") / F.lit(self.size)))
        index = bucketed.drop("is_anchor").groupBy("bucket").applyInArrow(_index, _INDEX)
        self.index = materialize(index, "negatives-index")
        self.anchors = materialize(rows.where("is_anchor").drop("is_anchor"), "negatives-anchors")

    def _visits(self, anchors: DataFrame, scouts: bool) -> DataFrame:
        """Anchors with the buckets they visit: the scouts' share of all, or the others."""
        step = max(1, isqrt(self.buckets))
        chosen = F.pmod(F.col("bucket") + F.xxhash64("no"), F.lit(step)) == 0
        spread = anchors.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1)))).withColumn(
            "bucket", F.col("bucket").cast("long")
        )
        spread = spread.where(chosen if scouts else ~chosen)
        reach = F.col("norm") * F.col("longest") * F.lit(1 + _SLACK) + F.lit(_SLACK)
        near = F.col("least").isNull() | (F.col("least") <= reach)
        return spread.join(self.index.select("bucket", "longest"), "bucket").where(near).drop("longest")

    def _found(self, anchors: DataFrame, scouts: bool, pick: Callable, label: str) -> DataFrame:
        """no, bound, score, vec_id of what the visited buckets give."""
        both = self.index.unionByName(self._visits(anchors, scouts), allowMissingColumns=True)
        dealt = both.repartitionById(self.buckets, F.col("bucket").cast("int")).sortWithinPartitions(
            "bucket", F.col("no").asc_nulls_first()
        )
        return materialize(dealt.mapInArrow(_search(pick, self.size), _FOUND), label)

    def _twice(self, anchors: DataFrame, sharpen: Callable, pick: Callable, n: int, label: str) -> DataFrame:
        """The best ``n`` per anchor and bound: scouts first, the other buckets with their bounds."""
        keys, order = ["no", "bound"], [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
        first = top_per_key(self._found(anchors, True, pick, label), keys, order, n, "rank")
        first = materialize(first, label)
        rest = self._found(sharpen(anchors, first), False, pick, label)
        return top_per_key(first.drop("rank").unionByName(rest), keys, order, n, "rank")

    def find_positives(self) -> DataFrame:
        """no (of the anchor), score, vec_id, rank of the anchors' positives."""
        bounds = F.lit(None).cast("array<long>")
        anchors = self.anchors.withColumns({"least": F.lit(None).cast("long"), "bounds": bounds, "floors": bounds})

        def sharpen(anchors: DataFrame, first: DataFrame) -> DataFrame:
            least = first.where(F.col("rank") == self.positives).select("no", F.col("score").alias("least"))
            return anchors.drop("least").join(least, "no", "left")

        pick = _pick_positives(self.positives)
        return self._twice(anchors, sharpen, pick, self.positives, "negatives-positives").drop("bound")

    def find_negatives(self, positives: DataFrame) -> DataFrame:
        """no, bound (a positive score), score, vec_id, rank of the negatives below each bound."""
        low, high = self.share
        floor = F.ceil(F.col("bound").cast("decimal(38,0)") * low / high).cast("long")
        bounds = positives.where("score >= 0").select("no", F.col("score").alias("bound")).distinct()
        bounds = bounds.withColumn("floor", floor)

        def with_bounds(bounds: DataFrame) -> DataFrame:
            lists = bounds.groupBy("no").agg(
                F.min("floor").alias("least"), F.sort_array(F.collect_list(F.struct("bound", "floor"))).alias("b")
            )
            return self.anchors.join(
                lists.select("no", "least", F.col("b.bound").alias("bounds"), F.col("b.floor").alias("floors")), "no"
            )

        def sharpen(anchors: DataFrame, first: DataFrame) -> DataFrame:
            nth = first.where(F.col("rank") == self.negatives).select("no", "bound", F.col("score").alias("nth"))
            sharper = bounds.join(nth, ["no", "bound"], "left")
            return with_bounds(sharper.withColumn("floor", F.greatest("floor", "nth")).drop("nth"))

        pick = _pick_negatives(self.negatives)
        return self._twice(with_bounds(bounds), sharpen, pick, self.negatives, "negatives-found")

    def mine(self) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
        positives = materialize(self.find_positives(), "negatives-best")
        found = self.find_negatives(positives)
        ids = self.anchors.select("no", F.col("vec_id").alias("anchor_id"))
        pairs = positives.select("no", F.col("vec_id").alias("positive_id"), F.col("score").alias("bound")).join(ids, "no")
        return pairs.join(found, ["no", "bound"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
            F.col("bound").alias("positive_score"), F.col("score").alias("negative_score"),
        )


def relabelled(vec_id: Column, label: Column, every: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one where the id is divisible by ``every``."""
    moved = F.when(vec_id % every == 0, (label + 1) % labels)
    return F.coalesce(moved, label)


def mine(vectors: DataFrame, anchor_every: int = 100, **options) -> DataFrame:
    """Hard negatives of ``vectors`` (vec_id, label, embedding); anchors are every so many ids."""
    rows = vectors.select(
        "vec_id", relabelled(F.col("vec_id"), F.col("label")).alias("label"),
        quantized(F.col("embedding")).alias("vector"),
    )
    return HardNegatives(rows, F.col("vec_id") % anchor_every == 0, **options).mine()
