"""Second-order gradient boosting from histograms, one grouped aggregate per depth.

Every round draws a share of the rows and of the columns and grows a tree level by level:
gradient, curvature and number of the rows are summed up per (node, feature, bin), and
each node takes the cut of the greatest gain

    GL^2 / (HL + penalty) + GR^2 / (HR + penalty) - G^2 / (H + penalty)

(halved). Leaves are ``-rate * G / (H + penalty)``. Gradients are summed as integers
(``SCALE`` steps per unit) and samples come from a hash of a row's key, so the trees do not
depend on the partitions or on the order of the rows.

Several fits on their own rows (folds, seeds) grow side by side in the same jobs. The rows
lie in blocks of one fit, column by column, which tasks read as arrays. Histograms of a node
meet in one task, which sums them up and cuts the node, so that the driver gets one row a
node (only up to about ``DIRECT`` histograms of nodes go there as they are). Margins are written to the shared
folder every few rounds, the more rows the sooner (:func:`rounds_kept`); in between a task
adds the trees since. No state lives in executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardspark.operators.ensembles import NODES, leaf_values
from hazardspark.session import discard, materialize

SCALE = 1 << 24
CELLS = 1 << 14  # cells counted per feature to place the bin borders
STORE = 20
STORE_ROWS = 2_700_000  # rows that a core walks down three trees in the time of a write
BLOCK_ROWS = 1 << 14
TASK_ROWS = 400_000  # rows of a task at most
LEAST_ROWS = 15_000  # rows worth a task of their own
DIRECT = 128
_LOSS = -1


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    rate: float = 0.05
    depth: int = 6
    subsample: float = 0.8
    columns: float = 0.8
    penalty: float = 1.0
    least_curvature: float = 1.0
    bins: int = 256
    seed: int = 42


@dataclass
class Boosted:
    """Trees of one fit: nodes as rows, the log-odds before the first tree, loss per round."""

    names: list[str]
    numeric: tuple[str, ...]
    categorical: dict[str, list[str]]
    base: float
    depth: int
    nodes: list[tuple] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    borders: list[list[float]] = field(default_factory=list)

    def features(self) -> Column:
        return feature_array(self.numeric, self.categorical)

    def node_table(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.nodes, NODES)


def feature_array(numeric, categorical: dict[str, list[str]]) -> Column:
    """Numerics and one-hot columns as one array; NULL where a numeric value is missing."""
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric]
    hot = [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in categorical.items() for v in vs]
    array = F.array(*values, *hot)
    return F.when(~F.exists(array, lambda v: v.isNull()), array)


def _borders(rows: DataFrame, fits: int, n: int, kinds: int, bins: int) -> list[list[np.ndarray]]:
    """Per fit and feature, upper borders of about equally filled bins, from exact counts of fine cells."""
    x = F.col("x")
    ranges = rows.groupBy("fit").agg(F.array(*[F.min(x[j]) for j in range(n)]), F.array(*[F.max(x[j]) for j in range(n)])).collect()
    low, high = (np.array([r[k] for r in sorted(ranges)]) for k in (1, 2))
    span = np.where(high > low, high - low, 1.0)
    at = F.col("fit")

    def cell(j: int) -> Column:
        place = F.floor((x[j] - F.lit(low[:, j].tolist())[at]) / F.lit(span[:, j].tolist())[at] * CELLS)
        return F.struct(F.lit(j).alias("j"), F.least(place, F.lit(CELLS - 1)).alias("cell"))

    counts = rows.select("fit", F.inline(F.array(*[cell(j) for j in range(n)]))).groupBy("fit", "j", "cell").agg(
        F.count(F.lit(1)).alias("n")).toArrow()
    fit, j, cells, count = (np.array(counts.column(c)) for c in ("fit", "j", "cell", "n"))
    out = []
    for k in range(fits):
        own = []
        for m in range(n):
            some = (fit == k) & (j == m)
            order = np.argsort(cells[some])
            filled, total = cells[some][order], np.cumsum(count[some][order])
            ends = np.unique(filled[np.searchsorted(total, np.arange(1, bins) * total[-1] / bins)])
            own.append((low[k, m] + (ends + 1) * (span[k, m] / CELLS))[ends < filled[-1]])
        out.append(own + [np.array([0.5])] * kinds)
    return out


_BLOCKS = "fit int, key binary, y binary, bins binary, margin binary"
_SUMS = "slot int, at binary, g binary, h binary, n binary"
_CUTS = "slot int, feature int, cut int, gain double, g long, h long, n long, gl long, hl long, nl long"
_CUT_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), *[pa.int64()] * 6]


def _binned(borders: list[list[np.ndarray]], bases: np.ndarray):
    """Blocks of the rows of one fit: keys, labels, bins (a column after the other) and margins."""

    def block(fit: int, held: list[tuple]) -> pa.RecordBatch:
        key, y, bins = (np.concatenate(c, axis=-1) for c in zip(*held))
        margin = np.full(len(key), bases[fit])
        columns = [pa.array([fit], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in (key, y, bins, margin)]]
        return pa.RecordBatch.from_arrays(columns, ["fit", "key", "y", "bins", "margin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            fit, key, y = (np.array(batch.column(c)) for c in ("fit", "key", "y"))
            for k in np.unique(fit).tolist():
                mine = fit == k
                bins = np.stack([np.searchsorted(b, x[mine, j]) for j, b in enumerate(borders[k])]).astype(np.uint8)
                held.setdefault(k, []).append((key[mine], y[mine], bins))
                if sum(len(part[0]) for part in held[k]) >= BLOCK_ROWS:
                    yield block(k, held.pop(k))
        for k, parts in held.items():
            yield block(k, parts)

    return run


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """fit, keys, labels, bins (features x rows) and margins of each block."""
    for batch in batches:
        for fit, *blobs in zip(batch.column("fit").to_pylist(), *[batch.column(c) for c in ("key", "y", "bins", "margin")]):
            key, y, bins, margin = (np.frombuffer(b.as_buffer(), t) for b, t in zip(blobs, (np.int64, float, np.uint8, float)))
            yield fit, key, y, bins.reshape(-1, len(key)), margin


def _uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) of each key and the seed."""
    x = key.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64


class _Tree:
    """A tree while it grows: node 0 is the root, children of i are 2i + 1 and 2i + 2."""

    def __init__(self, depth: int):
        size = (1 << (depth + 1)) - 1
        # A node without a split leads to itself: no bin lies beyond its cut.
        self.feature, self.cut, self.left = np.zeros(size, np.int64), np.full(size, 255), np.arange(size)
        self.value = np.zeros(size)

    def split(self, node: int, feature: int, cut: int) -> None:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, 2 * node + 1

    def place(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node of each column of ``bins`` (features x rows)."""
        rows = bins.shape[1]
        at, flat, row = np.zeros(rows, np.int64), bins.ravel(), np.arange(rows)
        first = self.feature * rows
        for _ in range(depth):
            at = self.left[at] + (flat[first[at] + row] > self.cut[at])
        return at


def rounds_kept(rows: float) -> int:
    """Rounds between two writes of the margins, by the rows of a core. Every level walks the trees
    since the last write, so writes and walks together cost least at the square root of their ratio."""
    return int(min(STORE, max(1, round(math.sqrt(STORE_ROWS / max(1, rows))))))


def _grown(margin: np.ndarray, bins: np.ndarray, fit: int, trees: list[list[_Tree]], depth: int) -> np.ndarray:
    """The margins after the trees that were grown since they were written."""
    for grown in trees:
        margin = margin + grown[fit].value[grown[fit].place(bins, depth)]
    return margin


def _stored(trees, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [_grown(margin, bins, fit, trees, depth).tobytes() for fit, _, _, bins, margin in _arrays([batch])]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins, pa.binary()))

    return run


def _histograms(fits: int, trees, growing: list[_Tree], level: int, drawn: np.ndarray, s: Settings, turn: int):
    """Per slot (fit, node of the level) the sums of the filled (drawn feature, bin); slot -1 - fit holds the loss."""
    first, width = (1 << level) - 1, 1 << level
    columns = np.flatnonzero(drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        loss = np.zeros(fits, np.int64)
        for fit, key, y, bins, margin in _arrays(batches):
            if level == 0:
                margin = _grown(margin, bins, fit, trees, s.depth)
                loss[fit] += np.rint((np.logaddexp(0, margin) - y * margin) * SCALE).astype(np.int64).sum()
            if not len(columns):
                continue
            keep = np.flatnonzero(_uniform(key, s.seed * 1000003 + turn) < s.subsample)
            margin, y, bins = margin[keep], y[keep], bins.take(keep, axis=1)
            if level:
                margin = _grown(margin, bins, fit, trees, s.depth)
                node = growing[fit].place(bins, level)
                still = np.flatnonzero(node >= first)
                if len(still) < len(node):
                    node, margin, y, bins = node[still], margin[still], y[still], bins.take(still, axis=1)
                start = (node - first) * 256
            else:
                start = np.zeros(len(keep), np.int64)
            p = 1 / (1 + np.exp(-margin))
            g, h = np.rint((p - y) * SCALE), np.rint(p * (1 - p) * SCALE)
            if fit not in totals:
                totals[fit] = np.zeros((3, width, len(columns), 256), np.int64)
            for at, j in enumerate(columns):
                place = start + bins[j]
                for total, weights in zip(totals[fit], (g, h, None)):
                    total[:, at] += np.bincount(place, weights, width * 256).reshape(width, 256).astype(np.int64)
        rows = [(_LOSS - k, b"", int(loss[k]).to_bytes(8, "little", signed=True), b"", b"") for k in np.flatnonzero(loss).tolist()]
        for fit, total in totals.items():
            flat = total.reshape(3, width, -1)
            for node in range(width):
                some = np.flatnonzero(flat[2, node])
                if len(some):
                    rows.append((fit * width + node, some.astype(np.int32).tobytes(), *[c.tobytes() for c in flat[:, node, some]]))
        for start in range(0, len(rows), 64):
            slots, *blobs = zip(*rows[start : start + 64])
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots, pa.int32()), *[pa.array(c, pa.binary()) for c in blobs]], ["slot", "at", "g", "h", "n"])

    return run


def _cuts(drawn: np.ndarray, s: Settings):
    """Sum up the histograms of each slot: its sums, the cut of the greatest gain and the sums to the left of it."""
    columns = np.flatnonzero(drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        loss: dict[int, int] = {}
        for batch in batches:
            for slot, at, *sums in zip(batch.column("slot").to_pylist(), *[batch.column(c) for c in ("at", "g", "h", "n")]):
                if slot < 0:
                    loss[slot] = loss.get(slot, 0) + int(np.frombuffer(sums[0].as_buffer(), np.int64)[0])
                    continue
                total = totals.setdefault(slot, np.zeros((3, len(columns) * 256), np.int64))
                total[:, np.frombuffer(at.as_buffer(), np.int32)] += [np.frombuffer(c.as_buffer(), np.int64) for c in sums]
        rows = [(slot, -1, -1, None, value, 0, 0, 0, 0, 0) for slot, value in loss.items()]
        for slot, total in totals.items():
            total = total.reshape(3, len(columns), 256)
            gains = _gains(total[0] / SCALE, total[1] / SCALE, s)
            j, cut = divmod(int(gains.argmax()), 256)
            left, whole = total[:, j, : cut + 1].sum(axis=1), total[:, j].sum(axis=1)
            rows.append((slot, int(columns[j]), cut, float(gains[j, cut]), *whole.tolist(), *left.tolist()))
        if rows:
            names = [c.split()[0] for c in _CUTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CUT_TYPES)], names)

    return run


def _gains(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """Gain of each cut (last axis: the last bin that goes left); -inf where it is not allowed."""
    gl, hl = np.cumsum(g, axis=-1), np.cumsum(h, axis=-1)
    gt, ht = gl[..., -1:], hl[..., -1:]
    gr, hr = gt - gl, ht - hl
    gain = (gl**2 / (hl + s.penalty) + gr**2 / (hr + s.penalty) - gt**2 / (ht + s.penalty)) / 2
    return np.where((hl >= s.least_curvature) & (hr >= s.least_curvature), gain, -np.inf)


def _drawn_columns(n: int, s: Settings, turn: int) -> np.ndarray:
    order = np.argsort(_uniform(np.arange(n, dtype=np.int64), s.seed * 7919 + turn + 1), kind="stable")
    drawn = np.zeros(n, bool)
    drawn[order[: max(1, int(s.columns * n))]] = True
    return drawn


def _grow(cuts: list[dict], growing: list[_Tree], level: int, borders, s: Settings, turn: int, models: list[Boosted]) -> bool:
    """Split the nodes of a level where it pays; True if some child can be split again."""
    first, width = (1 << level) - 1, 1 << level
    more = False
    for c in sorted((c for c in cuts if c["slot"] >= 0), key=lambda c: c["slot"]):
        k, i = divmod(c["slot"], width)
        node, tree, model = first + i, growing[k], models[k]
        whole, left = (c["g"], c["h"], c["n"]), (c["gl"], c["hl"], c["nl"])
        if not c["gain"] > 1e-9 * c["n"]:
            _leaf(model, tree, turn, node, whole, s)
            continue
        tree.split(node, c["feature"], c["cut"])
        border = float(borders[k][c["feature"]][c["cut"]])
        model.nodes.append((turn, node, c["feature"], border, 2 * node + 1, 2 * node + 2, c["gain"], float(c["n"]), None))
        if level + 1 < s.depth:
            more = True
            continue
        _leaf(model, tree, turn, 2 * node + 1, left, s)
        _leaf(model, tree, turn, 2 * node + 2, [a - b for a, b in zip(whole, left)], s)
    return more


def _leaf(model: Boosted, tree: _Tree, turn: int, node: int, sums, s: Settings) -> None:
    g, h, n = sums
    value = -s.rate * (g / SCALE) / (h / SCALE + s.penalty)
    tree.value[node] = value
    model.nodes.append((turn, node, -1, None, -1, -1, None, float(n), value))


def _local_session(spark):
    """A session for many short jobs on few groups; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        own.conf.set(name, "16")  # blocks
    return own


def _parts(rows: int, cores: int) -> int:
    """Tasks of a level: as many as there are cores, if each has rows enough, or whole turns of all cores."""
    few = min(cores, -(-rows // LEAST_ROWS))
    turns = -(-rows // (TASK_ROWS * cores))
    return few if turns <= 1 else turns * cores


def fit_many(df: DataFrame, fits: Column, label: str = "label", numeric=(), categorical=(), key: str | None = None,
             settings: Settings = Settings()) -> dict[int, Boosted]:
    """One boosted model per number in the array column ``fits``, each on the rows that name it.

    Rows without a label or some numeric feature are left out. ``key`` tells rows apart
    for sampling; without it a hash of the features does, and equal rows are drawn together.
    """
    if not 2 <= settings.bins <= 256:
        raise ValueError("bins must lie between 2 and 256")
    spark = df.sparkSession
    kinds = {c: sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().collect()) for c in categorical}
    x = feature_array(numeric, kinds)
    hashed = F.xxhash64("x", "y") if key is None else F.xxhash64(F.col("_key"))
    rows = df.select(F.explode(fits).alias("fit"), F.col(label).cast("double").alias("y"), x.alias("x"),
                     *([] if key is None else [F.col(key).alias("_key")])).where("x is not null and y is not null")
    rows = materialize(rows.select(F.col("fit").cast("int").alias("number"), hashed.alias("key"), "y", "x"), "boost-rows")
    shares = {r.number: r for r in rows.groupBy("number").agg(F.avg("y").alias("share"), F.count(F.lit(1)).alias("n")).collect()}
    numbers = sorted(shares)
    if not numbers:
        raise ValueError("no row with a label and all features")
    names = [*numeric, *[f"{c}_{v}" for c, vs in kinds.items() for v in vs]]
    bounded = [min(max(shares[k].share, 1e-6), 1 - 1e-6) for k in numbers]
    models = [Boosted(names, tuple(numeric), kinds, math.log(p / (1 - p)), settings.depth) for p in bounded]
    place = F.array_position(F.lit(numbers), F.col("number")) - 1
    rows = rows.select(place.cast("int").alias("fit"), "key", "y", "x")
    borders = _borders(rows, len(numbers), len(numeric), len(names) - len(numeric), settings.bins)
    for model, own_borders in zip(models, borders):
        model.borders = [b.tolist() for b in own_borders]
    # Tasks of a size that outweighs their start; a level is one short job.
    total, cores = sum(r.n for r in shares.values()), spark.sparkContext.defaultParallelism
    parts = _parts(total, cores)
    keep = rounds_kept(total / min(parts, cores))
    bases = np.array([m.base for m in models])
    # A task holds the rows of few fits, so its histograms are few.
    ranged = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, "fit", F.rand(0))
    stored = materialize(ranged.mapInArrow(_binned(borders, bases), _BLOCKS), "boost-bins")
    own, trees = _local_session(spark), []
    table = own.read.schema(_BLOCKS).parquet(stored._stored_at)

    def cuts_of(growing, level, drawn, turn):
        found = table.mapInArrow(_histograms(len(models), trees, growing, level, drawn, settings, turn), _SUMS)
        best = _cuts(drawn, settings)
        if (parts + len(models)) << level > DIRECT:
            found = found.repartition(min(cores, len(models) << level), "slot").mapInArrow(best, _CUTS)
            return found.toArrow().to_pylist()
        return [c for batch in best(found.toArrow().to_batches()) for c in batch.to_pylist()]

    def take_losses(cuts):
        sums = {_LOSS - c["slot"]: c["g"] for c in cuts if c["slot"] < 0}
        for k, model in enumerate(models):
            model.losses.append(float(sums.get(k, 0)) / SCALE / shares[numbers[k]].n)

    for turn in range(settings.rounds):
        growing = [_Tree(settings.depth) for _ in models]
        drawn = _drawn_columns(len(names), settings, turn)
        for level in range(settings.depth):
            cuts = cuts_of(growing, level, drawn, turn)
            if level == 0:
                take_losses(cuts)
            if not _grow(cuts, growing, level, borders, settings, turn, models):
                break
        trees.append(growing)
        if len(trees) == keep:
            old, stored = stored, materialize(stored.mapInArrow(_stored(trees, settings.depth), _BLOCKS), "boost-bins")
            discard(old)
            table, trees = own.read.schema(_BLOCKS).parquet(stored._stored_at), []
    take_losses(cuts_of([_Tree(settings.depth) for _ in models], 0, np.zeros(len(names), bool), settings.rounds))
    return dict(zip(numbers, models))


def fit(df: DataFrame, **options) -> Boosted:
    """One boosted model on all rows."""
    return fit_many(df, F.array(F.lit(0)), **options)[0]


def margins(df: DataFrame, model: Boosted, name: str = "margin", trees: int | None = None) -> DataFrame:
    """Add the log-odds after the first ``trees`` trees (all by default), by walking the node table."""
    nodes = model.node_table(df)
    nodes = nodes if trees is None else nodes.where(F.col("tree") < trees)
    walked = leaf_values(df, nodes, model.features(), model.depth, "_leaves")
    total = F.aggregate("_leaves", F.lit(model.base), lambda s, v: s + v)
    return walked.withColumn(name, total).drop("_leaves")


def score(df: DataFrame, model: Boosted, prob: str = "prob") -> DataFrame:
    """Add the probability of class 1; NULL for a row without some numeric feature."""
    out = margins(df, model, "_margin")
    return out.withColumn(prob, 1 / (1 + F.exp(-F.col("_margin")))).drop("_margin")


def _from_bins(model: Boosted):
    trees = [_Tree(model.depth) for _ in range(len(model.losses) - 1)]
    for tree, node, f, threshold, _, _, _, _, value in model.nodes:
        if f >= 0:
            trees[tree].split(node, f, int(np.searchsorted(model.borders[f], threshold)))
        else:
            trees[tree].value[node] = value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("_x").flatten()).reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(b, x[:, k]) for k, b in enumerate(model.borders)]).astype(np.uint8)
            margin = np.full(len(x), model.base)
            for tree in trees:
                margin += tree.value[tree.place(bins, model.depth)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(margin)], ["_key", "margin"])

    return run


def binned_margins(df: DataFrame, model: Boosted, key: str) -> DataFrame:
    """``key`` and the log-odds by the trees over bins, as a fit itself adds them up."""
    rows = df.select(F.col(key).alias("_key"), model.features().alias("_x")).where("_x is not null")
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(_from_bins(model), f"_key {kind}, margin double").withColumnRenamed("_key", key)


def split_audit(df: DataFrame, model: Boosted, tree: int, label: str, key: str, settings: Settings = Settings()) -> DataFrame:
    """Per split of a tree (``node``): its recorded ``gain`` and the ``best`` gain of any drawn
    column and bin border, by plain aggregates over the rows that reach the node."""
    x, s = F.col("_input"), settings
    known = df.withColumn("_input", model.features()).where(F.col("_input").isNotNull() & F.col(label).isNotNull())
    rows = margins(known, model, "_m", tree).withColumn("_p", 1 / (1 + F.exp(-F.col("_m"))))
    rows = rows.select(
        F.xxhash64(key).alias("_key"), "_input", F.rint((F.col("_p") - F.col(label)) * SCALE).alias("g"),
        F.rint(F.col("_p") * (1 - F.col("_p")) * SCALE).alias("h"))
    drawn = rows.mapInArrow(_sample(s, tree), rows.schema)
    splits = sorted((n for n in model.nodes if n[0] == tree and n[2] >= 0), key=lambda n: n[1])
    reached, visits = {0: F.lit(True)}, []
    for _, node, f, threshold, left, right, gain, _, _ in splits:
        low = x[f] <= F.lit(threshold)
        reached[left], reached[right] = reached[node] & low, reached[node] & ~low
        visits.append(F.when(reached[node], F.struct(F.lit(node).alias("node"), F.lit(gain).alias("gain"))))
    columns = np.flatnonzero(_drawn_columns(len(model.names), s, tree)).tolist()
    bins = [
        F.named_struct(F.lit("j"), F.lit(j), F.lit("bin"), F.size(F.filter(F.lit(model.borders[j]), _below(x[j]))))
        for j in columns
    ]
    long = drawn.select("g", "h", F.array(*bins).alias("bins"), F.explode(F.array_compact(F.array(*visits))).alias("at"))
    long = long.select("g", "h", "at.node", "at.gain", F.inline("bins"))
    sums = long.groupBy("node", "gain", "j", "bin").agg((F.sum("g") / SCALE).alias("g"), (F.sum("h") / SCALE).alias("h"))
    whole = Window.partitionBy("node", "j")
    parts = {"gl": F.sum("g").over(whole.orderBy("bin")), "hl": F.sum("h").over(whole.orderBy("bin")),
             "gt": F.sum("g").over(whole), "ht": F.sum("h").over(whole)}
    gl, hl, gt, ht = (F.col(c) for c in parts)
    gain = (gl**2 / (hl + s.penalty) + (gt - gl) ** 2 / (ht - hl + s.penalty) - gt**2 / (ht + s.penalty)) / 2
    allowed = (hl >= s.least_curvature) & (ht - hl >= s.least_curvature)
    return sums.withColumns(parts).groupBy("node", "gain").agg(F.max(F.when(allowed, gain)).alias("best"))


def _below(value: Column):
    return lambda border: border < value


def _sample(s: Settings, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_uniform(np.array(batch.column("_key")), s.seed * 1000003 + turn) < s.subsample))

    return run
