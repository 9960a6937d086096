"""Nearest neighbours and thinning against brute force."""

import math
import random

import pytest

from hazardspark.operators import neighbours


def brute(queries, refs, k):
    out = {}
    for qx, qy in set(queries):
        near = sorted((math.sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)), i) for i, x, y in refs)
        out[(qx, qy)] = [(i, d) for d, i in near[:k]]
    return out


def points(kind, n, seed):
    rnd = random.Random(seed)
    if kind == "uniform":
        return [(rnd.uniform(0, 100), rnd.uniform(0, 100)) for _ in range(n)]
    if kind == "hot tile":  # a third within a metre, far from the rest
        return [(50 + rnd.random(), 50 + rnd.random()) if i % 3 == 0 else (rnd.uniform(0, 1e5), rnd.uniform(0, 1e5))
                for i in range(n)]
    if kind == "repeated spot":
        return [(7.0, 7.0) if i % 3 == 0 else (float(rnd.randrange(10)), float(rnd.randrange(10))) for i in range(n)]
    if kind == "line":
        return [(rnd.uniform(0, 1000), 5.0) for _ in range(n)]
    if kind == "outside":
        return [(rnd.uniform(-5000, 9000), rnd.uniform(-5000, 9000)) for _ in range(n)]
    raise ValueError(kind)


CASES = [("uniform", "uniform", 1), ("uniform", "uniform", 5), ("hot tile", "hot tile", 5), ("uniform", "repeated spot", 5),
         ("repeated spot", "line", 3), ("outside", "uniform", 4), ("uniform", "hot tile", 1)]


@pytest.mark.parametrize("q_kind,r_kind,k", CASES)
def test_nearest_is_exact(spark, q_kind, r_kind, k):
    qs = points(q_kind, 150, 1)
    refs = [(i, x, y) for i, (x, y) in enumerate(points(r_kind, 300, 2))]
    q = spark.createDataFrame(qs, "x double, y double")
    r = spark.createDataFrame(refs, "id long, x double, y double")
    got = {}
    for row in neighbours.nearest(q, r, "id", k, leaf=8).collect():
        got.setdefault((row.x, row.y), []).append((row.neighbour, row.id, row.distance))
    want = brute(qs, refs, k)
    assert {p: [(i, d) for _, i, d in sorted(v)] for p, v in got.items()} == want


def test_fewer_references_than_k(spark):
    q = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    r = spark.createDataFrame([(1, 3.0, 4.0), (2, 6.0, 8.0)], "id long, x double, y double")
    assert [(x.id, x.distance) for x in neighbours.nearest(q, r, "id", 5).sort("neighbour").collect()] == [(1, 5.0), (2, 10.0)]
    assert neighbours.nearest(q, r.limit(0), "id", 5).count() == 0


@pytest.mark.parametrize("radius", [0.5, 20.0, 3000.0])
def test_exclude_within(spark, radius):
    qs, rs = points("hot tile", 200, 3), points("uniform", 200, 4)
    q = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(qs)], "qid long, x double, y double")
    r = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rs)], "id long, x double, y double")
    got = {x.qid for x in neighbours.exclude_within(q, r, radius, "id").collect()}
    want = {i for i, (x, y) in enumerate(qs) if all(math.hypot(x - a, y - b) >= radius for a, b in rs)}
    assert got == want


def greedy(rows, metres, limit=None):
    kept = []
    for _, key, x, y in sorted(rows):
        if all(math.sqrt((x - a) ** 2 + (y - b) ** 2) >= metres for _, a, b in kept):
            kept.append((key, x, y))
            if limit and len(kept) == limit:
                break
    return {k for k, _, _ in kept}


@pytest.mark.parametrize("kind,metres,limit", [
    ("uniform", 12.0, None), ("uniform", 12.0, 5), ("hot tile", 4000.0, None), ("hot tile", 0.3, 40), ("repeated spot", 1.0, None)])
def test_thinning_equals_sequential_greedy(spark, kind, metres, limit):
    rnd = random.Random(9)
    rows = [(rnd.randrange(10**6), i, x, y) for i, (x, y) in enumerate(points(kind, 400, 5))]
    df = spark.createDataFrame(rows, "rank long, id long, x double, y double")
    got = {r.id for r in neighbours.thin_by_spacing(df, metres, "rank", "id", limit).collect()}
    assert got == greedy(rows, metres, limit)


def test_thinning_rules_on_nulls(spark):
    rows = [(None if i == 0 else i, i, float(i), 0.0) for i in range(40)] + [(5, 90, None, 1.0), (6, 91, 2.0, float("nan"))]
    df = spark.createDataFrame(rows, "rank long, id long, x double, y double")
    got = {r.id for r in neighbours.thin_by_spacing(df, 1.5, "rank", "id").collect()}
    assert got == set(range(1, 40, 2))  # the row without a rank comes last and is too near; rows without a place are out
    first = [r.id for r in neighbours.thin_by_spacing(df, 1.5, "rank", "id", 3).sort("id").collect()]
    assert first == [1, 3, 5]
    few = {r.id for r in neighbours.thin_by_spacing(df.where("id < 8"), 1.5, "rank", "id", 3).collect()}
    assert few == set(first)  # whatever the size of the table
    assert neighbours.thin_by_spacing(df.where("x is null"), 1.5, "rank", "id").count() == 0


def test_selection_is_exact_with_outliers_and_ties(spark):
    import random

    from hazardspark.operators import selection

    rnd = random.Random(3)
    values = [rnd.gauss(0, 1) for _ in range(3001)] + [7.5] * 500 + [1e300, -1e300, 5e-324, 0.0, 1.7e308, -1.7e308]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    ranks = [0, 1, 17, 1753, 3000, 3400, len(values) - 1]
    assert selection.order_statistics(df, "v", ranks) == [sorted(values)[r] for r in ranks]
    assert selection.quantile(spark.createDataFrame([(1.0,), (2.0,), (5.0,), (9.0,)], "v double"), "v") == 3.5
    assert selection.quantile(df.where("false"), "v") is None


def test_distance_stats_hold_no_list_of_values(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as distance")
    out = neighbours.distance_stats(df, 10.0)
    assert out.first().asDict() == {"n": 1001, "min_distance": 0.0, "median_distance": 500.0, "mean_distance": 500.0, "below": 10}
    assert "percentile" not in out._jdf.queryExecution().toString()


def test_label_of_a_repeated_reference_id_adds_no_row(spark):
    refs = spark.createDataFrame([(1, 0.0, 0.0, "near"), (1, 5.0, 5.0, "far"), (2, 9.0, 9.0, "b")], "id int, x double, y double, label string")
    df = spark.createDataFrame([(0.1, 0.0), (8.0, 9.0), (5.0, 4.9)], "x double, y double")
    out = neighbours.nearest_label(df, refs, "label", "id", "x", "y").collect()
    assert sorted((r.x, r.label) for r in out) == [(0.1, "near"), (5.0, "far"), (8.0, "b")]


def test_rows_without_a_place_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    refs = spark.createDataFrame([(i, float(i % 20), float(i // 20)) for i in range(400)] + [(900, nan, 0.0), (901, 0.0, inf), (902, None, 1.0)],
                                 "id int, x double, y double")
    df = spark.createDataFrame([(3.2, 4.1), (nan, 1.0), (None, 1.0), (inf, 0.0), (19.0, 19.4)], "x double, y double")
    out = {(r.x, r.y): r.id for r in neighbours.nearest(df, refs, "id").collect()}
    assert out == {(3.2, 4.1): 83, (19.0, 19.4): 399}
