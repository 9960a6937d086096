"""Models, splits and background samples on small data."""

import math
import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation, functions as F

from hazardspark.operators import attribution, boosting, dataset, ensembles, metrics, models, spatial

COLS = dict(numeric=("a", "b"), categorical=("kind",))


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 1)
        kind = rnd.choice(["10", "30"])
        y = int(1.5 * a - b + (0.8 if kind == "30" else 0.0) + rnd.gauss(0, 0.7) > 0)
        rows.append((i, i % 12, a, b, kind, y))
    return spark.createDataFrame(rows, "id long, block int, a double, b double, kind string, label int").persist()


def auc(df):
    return metrics.roc_auc(df).first().roc_auc


@pytest.mark.parametrize("fit,kw", [
    (models.fit_logistic, {}), (models.fit_forest, {"trees": 20}), (models.fit_boosted, {"rounds": 5, "depth": 3})])
def test_fits_rank_held_out_groups(data, fit, kw):
    split = dataset.group_holdout(data, "block")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    assert test.select("block").distinct().count() == math.ceil(12 * 0.2)
    assert train.join(test, "block").count() == 0
    scored = models.score(test, fit(train, **kw, **COLS))
    assert scored.columns == [*test.columns, "prob"]
    low, high = scored.agg(F.min("prob"), F.max("prob")).first()
    assert 0.0 <= low <= high <= 1.0
    assert auc(scored) > 0.85


@pytest.mark.parametrize("fit,kw", [(models.fit_logistic, {}), (models.fit_forest, {"trees": 5})])
def test_scores_after_an_observed_query(data, spark, fit, kw):
    """An observation leaves a manager in the session that cannot go to tasks."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    scored = models.score(data, fit(data, **kw, **COLS))
    assert scored.agg(F.count("prob")).first()[0] == 600


def test_walks_and_terms_after_an_observed_query(data, spark):
    """The steps of k10, k12 (nodes of a forest) and l2 (transformed samples) beyond the score."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    walked = models.walked_probability(data, models.fit_forest(data, trees=5, **COLS))
    assert walked.agg(F.count("walked")).first()[0] == 600
    rows = models.transformed(data, models.fit_logistic(data, **COLS), **COLS)
    assert rows.agg(F.count("logit")).first()[0] == 600


def test_unknown_category_is_all_zeros(data, spark):
    fitted = models.prep_pipeline(data.count(), **COLS).fit(data)
    new = spark.createDataFrame([(0.0, 0.0, "99")], "a double, b double, kind string")
    assert fitted.transform(new).select(vector_to_array("features")).first()[0][2:] == [0.0, 0.0]


def test_numerics_are_scaled_by_the_population_deviation(data):
    ready = models.prep_pipeline(data.count(), **COLS).fit(data).transform(data)
    first = ready.select(vector_to_array("features")[0].alias("v"))
    assert first.agg(F.stddev_pop("v")).first()[0] == pytest.approx(1.0, abs=1e-12)


def test_missing_features_leave_the_row_without_score(data, spark):
    holed = data.withColumn("a", F.when(F.col("id") % 10 != 0, F.col("a")))
    holed = holed.withColumn("b", F.when(F.col("id") % 10 == 1, float("nan")).otherwise(F.col("b")))
    holed = holed.withColumn("kind", F.when(F.col("id") % 10 != 2, F.col("kind")))
    assert models.missing_features(holed, ("a", "b")).first() == (600, 120)
    for fit, kw in ((models.fit_logistic, {"parts": 2}), (models.fit_forest, {"trees": 5})):
        scored = models.score(holed, fit(holed, **kw, **COLS))
        gone = {r.id % 10 for r in scored.where("prob IS NULL").select("id").collect()}
        assert scored.count() == 600 and gone == {0, 1}
        assert scored.where("prob IS NOT NULL AND NOT isnan(prob)").count() == 480


def test_report_equals_the_single_metrics(data):
    scored = models.score(data, models.fit_logistic(data, **COLS)).persist()
    got = {r.metric: r.value for r in metrics.report(scored).collect()}
    want = {}
    for part in (metrics.roc_auc(scored), metrics.average_precision(scored), metrics.brier(scored), metrics.confusion(scored)):
        want.update(part.first().asDict())
    assert list(got) == list(want)
    assert all(got[k] == pytest.approx(float(want[k]), abs=1e-12) for k in want)


def test_seed_stability_names_the_models(data):
    fits = {"lr": models.fit_logistic, "again": models.fit_logistic}
    rows = models.seed_stability(data, "block", "id", [1, 2], fits, metres=None, **COLS).collect()
    assert sorted((r.model, r.seed) for r in rows) == [("again", 1), ("again", 2), ("lr", 1), ("lr", 2)]


def test_ranking_names_every_feature(data, spark):
    rows = models.feature_ranking(spark, models.fit_logistic(data, **COLS), **COLS).collect()
    assert {r.feature for r in rows} == {"a", "b", "kind_10", "kind_30"}
    assert rows[0].feature == "a" and rows[0].value > 0
    assert [abs(r.value) for r in rows] == sorted((abs(r.value) for r in rows), reverse=True)


def test_fitted_terms_are_optimal_and_add_up(data):
    holed = data.withColumn("a", F.when(F.col("id") % 10 != 0, F.col("a")))
    model = models.fit_logistic(holed, **COLS)
    terms, intercept = models.linear_terms(model, **COLS)
    assert list(terms) == ["num__a", "num__b", "cat__kind_10", "cat__kind_30"]
    gradient = {r.feature: r.gradient for r in models.penalised_gradient(holed, model, **COLS).collect()}
    assert set(gradient) == {"intercept", *terms}
    assert max(abs(g) for g in gradient.values()) < 1e-4
    rows = models.transformed(holed, model, **COLS)
    assert rows.count() == 540
    means = attribution.background(rows, list(terms))
    phi = attribution.linear_attribution(rows, terms, means)
    base = attribution.base_value(means, terms, intercept)
    check = attribution.additivity_check(rows, phi, base, terms, intercept, own="logit").first()
    assert check["rows"] == 540 and check.max_gap < 1e-9
    off = rows.withColumn("logit", F.col("logit") + F.when(F.col("id") == 1, 1.0).otherwise(0.0))
    assert attribution.additivity_check(off, phi, base, terms, intercept, own="logit").first().max_gap > 0.99


def test_cross_validation_covers_all_folds(data):
    long = models.cross_validate(data, "block", "id", {"lr": models.fit_logistic}, k=3, metres=None, **COLS).persist()
    assert {(r.model, r.fold) for r in long.collect()} == {("lr", 0), ("lr", 1), ("lr", 2)}
    best = {r.metric: r.mean for r in metrics.cv_summary(long).collect()}
    assert best["roc_auc"] > 0.85 and 0 < best["brier"] < 0.25


def test_negatives_keep_their_distances(spark):
    rnd = random.Random(8)
    cells = [(r, c, 27.0 + r * 0.004, 88.0 + c * 0.004, rnd.randrange(10**9)) for r in range(40) for c in range(40)]
    cand = spark.createDataFrame(cells, "r int, c int, latitude double, longitude double, rank long")
    inv = [(i, 27.0 + rnd.random() * 0.16, 88.0 + rnd.random() * 0.16, f"D{i % 3}", 100 + i) for i in range(12)]
    inventory = spark.createDataFrame(inv, "sl_no long, latitude double, longitude double, district string, density int")
    neg = dataset.negatives(cand, inventory, 25, interpolate="density").collect()
    assert sorted(r.sample_id for r in neg) == [f"BG_{i:04d}" for i in range(1, 26)]

    def metres(p, q):
        return math.hypot((p[1] - q[1]) * 98500.0, (p[0] - q[0]) * 111000.0)

    spots = [(r.latitude, r.longitude) for r in neg]
    places = [(la, lo) for _, la, lo, _, _ in inv]
    assert min(metres(a, b) for a in spots for b in places) >= 1000.0
    assert min(metres(a, b) for i, a in enumerate(spots) for b in spots[:i]) >= 800.0
    for r in neg:
        near = sorted((math.hypot(r.longitude - lo, r.latitude - la), i, d, v) for i, la, lo, d, v in inv)
        assert r.district == near[0][2]
        w = [(1 / max(d, 1e-6), v) for d, _, _, v in near[:5]]
        assert abs(r.density - sum(a * v for a, v in w) / sum(a for a, _ in w)) <= 0.5 + 1e-9


def test_buffer_separates_train_from_test(spark):
    rnd = random.Random(2)
    rows = [(i, 27.0 + rnd.random() * 0.2, 88.0 + rnd.random() * 0.2) for i in range(200)]
    df = spatial.local_metres(spark.createDataFrame(rows, "id long, latitude double, longitude double"))
    split = dataset.group_holdout(dataset.spatial_blocks(df, 4), "spatial_block")
    out = dataset.buffered_train(split, "id", 900.0).collect()
    test = [(r.x, r.y) for r in out if r.is_test]
    train = [(r.x, r.y) for r in out if not r.is_test]
    assert len(test) == split.where("is_test").count() and train
    assert min(math.dist(a, b) for a in train for b in test) >= 900.0


SMALL = boosting.Settings(rounds=6, depth=3)


@pytest.fixture(scope="module")
def boosted(data):
    return boosting.fit(data, key="id", settings=SMALL, **COLS)


def test_boosting_does_not_depend_on_partitions(data, boosted):
    again = boosting.fit(data.repartition(13), key="id", settings=SMALL, **COLS)
    assert (again.nodes, again.losses) == (boosted.nodes, boosted.losses)
    assert len(boosted.losses) == 7 and all(b < a for a, b in zip(boosted.losses, boosted.losses[1:]))
    other = boosting.fit(data, key="id", settings=boosting.Settings(rounds=2, depth=3, seed=1), **COLS)
    assert other.nodes != [n for n in boosted.nodes if n[0] < 2]


@pytest.mark.parametrize("tree", [0, 5])
def test_every_split_is_the_best_of_its_histogram(data, boosted, tree):
    audit = boosting.split_audit(data, boosted, tree, "label", "id", SMALL).collect()
    assert {r.node for r in audit} == {n[1] for n in boosted.nodes if n[0] == tree and n[2] >= 0}
    assert all(r.gain == pytest.approx(r.best, rel=1e-9) for r in audit)


def test_one_tree_by_hand(spark):
    """Two values, no sampling: one cut, leaves from gradient and curvature of the share 1/2."""
    df = spark.createDataFrame([(i, float(i >= 10), int(i >= 10)) for i in range(20)], "id long, v double, label int")
    one = boosting.Settings(rounds=1, depth=3, rate=0.1, subsample=1.0, columns=1.0)
    model = boosting.fit(df, key="id", numeric=("v",), settings=one)
    (split,) = [n for n in model.nodes if n[2] >= 0]
    g, h = 10 * 0.5, 10 * 0.25
    assert split[6] == pytest.approx((g * g / (h + 1) * 2) / 2) and 0 <= split[3] < 1
    assert sorted(n[8] for n in model.nodes if n[2] < 0) == pytest.approx([-0.1 * g / (h + 1), 0.1 * g / (h + 1)])


def test_walk_equals_the_models_own(data, boosted):
    own = boosting.binned_margins(data, boosted, "id")
    both = boosting.margins(data, boosted).join(own.withColumnRenamed("margin", "own"), "id")
    assert both.where(F.abs(F.col("margin") - F.col("own")) < 1e-9).count() == 600
    forest = models.fit_forest(data, trees=20, **COLS)
    walked = models.walked_probability(models.score(data, forest), forest)
    assert walked.where(F.abs(F.col("prob") - F.col("walked")) < 1e-9).count() == 600
    ranked = {r.feature: r.value for r in models.feature_ranking(data.sparkSession, forest, **COLS).collect()}
    nodes = ensembles.forest_nodes(forest, data.sparkSession)
    summed = ensembles.importances(nodes, models.feature_names(forest, **COLS)).collect()
    assert {r.feature: r.value for r in summed} == pytest.approx(ranked)


def test_fits_side_by_side_are_the_fits_alone(data, monkeypatch):
    monkeypatch.setattr(boosting, "STORE", 2)
    short = boosting.Settings(rounds=5, depth=2)
    both = boosting.fit_many(data, F.when(F.col("id") % 2 == 0, F.array(F.lit(3), F.lit(8))).otherwise(F.array(F.lit(8))),
                             key="id", settings=short, **COLS)
    alone = boosting.fit(data, key="id", settings=short, **COLS)
    assert set(both) == {3, 8} and both[8].nodes == alone.nodes and both[3].nodes != alone.nodes


def test_boosting_leaves_out_incomplete_rows(data, spark):
    holed = data.withColumn("a", F.when(F.col("id") % 10 != 0, F.col("a"))).withColumn(
        "b", F.when(F.col("id") % 10 == 1, float("nan")).otherwise(F.col("b")))
    scored = models.score(holed, models.fit_boosted(holed, rounds=2, depth=2, key="id", **COLS))
    assert {r.id % 10 for r in scored.where("prob IS NULL").select("id").collect()} == {0, 1}
    with pytest.raises(ValueError):
        boosting.fit(data.where("false"), **COLS)
    same = spark.createDataFrame([(i, 1.0, i % 2) for i in range(9)], "id long, v double, label int")
    flat = boosting.fit(same, key="id", numeric=("v",), settings=SMALL)  # no cut at all
    assert all(n[2] == -1 for n in flat.nodes)


def test_validation_takes_many_models(data):
    fits = {"lr": models.fit_logistic, "gb": models.Fit(models.fit_boosted, {"rounds": 3, "key": "id"}, models.fit_boosted_many)}
    rows = models.seed_stability(data, "block", "id", [1, 2], fits, metres=None, **COLS).collect()
    assert sorted((r.model, r.seed) for r in rows) == [("gb", 1), ("gb", 2), ("lr", 1), ("lr", 2)]
    assert all(r.roc_auc > 0.8 for r in rows)


def test_margins_are_written_sooner_for_more_rows():
    kept = [boosting.rounds_kept(n) for n in (1_000, 30_000, 100_000, 1_000_000, 100_000_000)]
    assert kept == sorted(kept, reverse=True) and kept[0] == boosting.STORE and kept[-1] == 1


def test_one_partition_of_a_fit_holds_a_share_of_the_rows(data):
    rows, n = models._training_rows(data.repartition(6), "label", ("a", "b"), ("kind",), None)
    assert n == 600 and rows.rdd.getNumPartitions() == 1
    rows.unpersist()


def test_folds_and_seeds_are_fitted_at_the_same_time(data):
    """All fits wait for each other: one after the other they would never end."""
    met = threading.Barrier(3, timeout=60)

    def fit(train, **kw):
        met.wait()
        return models.fit_logistic(train, **kw)

    placed = data.withColumns({"x": F.col("a") * 1e6, "y": F.col("b") * 1e6})
    out = models.seed_stability(placed, "block", "id", [1, 2, 3], {"logistic": fit}, **COLS).collect()
    assert [(r.model, r.seed) for r in out] == [("logistic", 1), ("logistic", 2), ("logistic", 3)]
    assert all(r.roc_auc > 0.85 for r in out)


def test_tasks_cut_the_nodes_and_send_one_row_a_node():
    """Blocks dealt to two tasks give the cuts of one task; rows follow the nodes, not the bins."""
    rng = np.random.default_rng(5)
    borders = [[np.linspace(0.01, 0.99, 200)] * 3] * 2
    x = rng.random((5000, 3))
    batch = pa.RecordBatch.from_pydict({
        "fit": pa.array(rng.integers(0, 2, 5000), pa.int32()), "key": rng.integers(-2**62, 2**62, 5000),
        "y": (x[:, 1] > 0.4).astype(float), "x": x.tolist()})
    drawn, settings = np.array([True, True, False]), boosting.Settings(depth=3)
    growing = [boosting._Tree(3), boosting._Tree(3)]
    growing[0].split(0, 0, 99)

    def sums(rows, level):
        blocks = boosting._binned(borders, np.array([0.1, -0.2]))(iter([rows]))
        return list(boosting._histograms(2, [], growing, level, drawn, settings, 0)(blocks))

    def cuts(parts):
        found = [c for b in boosting._cuts(drawn, settings)(iter(parts)) for c in b.to_pylist()]
        return sorted(found, key=lambda c: c["slot"])

    for level, slots in ((0, [-2, -1, 0, 1]), (1, [0, 1])):  # the second fit has no split
        whole = sums(batch, level)
        assert sorted(s for b in whole for s in b.column("slot").to_pylist()) == slots
        one = cuts(whole)
        assert one == cuts(sums(batch.slice(0, 1700), level) + sums(batch.slice(1700), level))
        assert [c["slot"] for c in one] == slots
        assert all(c["feature"] == 1 and 0 < c["nl"] < c["n"] for c in one if c["slot"] >= 0)


def test_tasks_of_a_level_follow_the_cores():
    assert [boosting._parts(n, 12) for n in (1, 30_000, 900_000, 4_800_000, 4_800_001)] == [1, 2, 12, 12, 24]


def test_forest_rows_lie_in_even_partitions(data):
    """No more than there are cores, and no partition of a file's size."""
    many = data.coalesce(1).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(400))))
    rows, n = models._training_rows(many, "label", ("a", "b"), ("kind",), None)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    rows.unpersist()
    assert n == 240_000 and len(sizes) == 8 and max(sizes) - min(sizes) <= 8


def test_walk_keeps_rows_without_features(spark):
    nodes = spark.createDataFrame(
        [(0, 0, 0, 0.5, 1, 2, 1.0, 2.0, None), (0, 1, -1, None, -1, -1, None, 1.0, 0.25), (0, 2, -1, None, -1, -1, None, 1.0, 0.75),
         (1, 0, -1, None, -1, -1, None, 2.0, 0.5)], ensembles.NODES)
    df = spark.createDataFrame([(1, [0.5]), (2, None), (3, [0.6]), (4, [float("nan")])], "id int, x array<double>")
    got = {r.id: r.leaves for r in ensembles.leaf_values(df, nodes, F.col("x"), 1).collect()}
    assert got == {1: [0.25, 0.5], 2: None, 3: [0.75, 0.5], 4: [0.75, 0.5]}


def test_forest_in_many_passes_is_whole(data, monkeypatch):
    """Rows keep their node, and passes of few histograms grow as many trees, as deep."""
    monkeypatch.setattr(models, "PASS_MB", 0)  # a node a pass
    small = models.fit_forest(data, trees=3, depth=4, **COLS)
    monkeypatch.undo()
    forest = models.fit_forest(data, trees=3, depth=4, **COLS).stages[-1]
    assert small.stages[-1].getMaxMemoryInMB() == 0 and forest.getCacheNodeIds() and forest.getMaxMemoryInMB() == 64
    assert small.stages[-1].getNumTrees == forest.getNumTrees == 3
    assert abs(small.stages[-1].totalNumNodes - forest.totalNumNodes) < forest.totalNumNodes / 3
    assert auc(models.score(data, small)) > 0.85
