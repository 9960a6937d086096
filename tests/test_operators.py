"""Unit tests of single operators on small literals."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from hazardspark.functions import dates
from hazardspark.functions.numeric import clip01, nan_to_null
from hazardspark.functions.risk import rain_index, risk_score
from hazardspark.functions.tiers import alert_severity, micro_tier, risk_tier, susceptibility_tier
from hazardspark.operators import (
    alerts, catalogue, dashboard, dataset, feeds, grid, metrics, ordering, quality, rainfall, spatial, terrain)
from hazardspark.params import Axis, Box, GridMeta
from hazardspark.session import new_path
from hazardspark.sources import raster, tables


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_null_and_nan_never_become_numbers(spark):
    none = F.lit(None).cast("double")
    r = one(spark, clip01(none), nan_to_null(F.lit(float("nan"))), risk_score(F.lit(0.6), none), risk_score(F.lit(1.7), none),
            rain_index(F.lit(1.0), none, F.lit(1.0)), risk_tier(none), alert_severity(none), susceptibility_tier(none))
    assert tuple(r) == (None, None, 0.6, 1.0, None, "Unknown", None, None)


def test_tier_edges_are_inclusive(spark):
    r = one(spark, *[risk_tier(F.lit(v)) for v in (0.75, 0.7499, 0.55, 0.35, 0.3499)],
            susceptibility_tier(F.lit(0.7)), micro_tier(F.lit(0.8)), alert_severity(F.lit(0.55)), alert_severity(F.lit(0.75)))
    assert tuple(r) == ("Very High", "High", "High", "Moderate", "Low", "Very High", "Extreme", "HIGH", "VERY HIGH")


TEXTS = [
    ("4 May 2012", dt.date(2012, 5, 4)), ("4th Sept 2012", None), ("21st oct 2015", dt.date(2015, 10, 21)),
    ("18-19 October 2021", dt.date(2021, 10, 19)), ("18th & 19th October 2021", dt.date(2021, 10, 19)),
    ("July 2020, 4 October 2023", dt.date(2023, 10, 4)), ("4 October 2023, July 2020", dt.date(2023, 10, 4)),
    ("3 May 2012 at 18:30, 4 May 2012", dt.date(2012, 5, 3)), ("7 June 2012 in the midnight", dt.date(2012, 6, 7)),
    ("2012-06-07", dt.date(2012, 6, 7)), ("31 February 2012", None), ("2018", None), ("NA", None), ("", None), (None, None),
    ("2nd week of August 2022", None), (" 5 Aug 2000. ", dt.date(2000, 8, 5)),
]


def test_event_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i int, history string")
    got = {r.i: r.event_date for r in catalogue.with_event_date(df).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [d for _, d in TEXTS]


def test_range_start_and_audit_variants(spark):
    texts = ["18-19 October 2021", "3 May 2012 at 18:30, 4 May 2012", "18 to 19 October 2021", "mid August 2020"]
    df = spark.createDataFrame([(t,) for t in texts], "history string")
    first = [r[0] for r in df.select(dates.event_date(F.col("history"), range_end=False)).collect()]
    audit = [r[0] for r in df.select(dates.audit_date(F.col("history"))).collect()]
    assert first == [dt.date(2021, 10, 18), dt.date(2012, 5, 3), dt.date(2021, 10, 19), None]
    assert audit == [dt.date(2021, 10, 19), dt.date(2012, 5, 4), dt.date(2021, 10, 19), None]
    status = [r.status for r in catalogue.classify_dates(df, cutoff_year=2015).collect()]
    assert status == ["suspicious", "usable", "suspicious", "ambiguous"]


def daily(spark, days, cell=1, start=dt.date(2012, 6, 1)):
    rows = [(cell, start + dt.timedelta(i), float(v)) for i, v in enumerate(days) if v is not None]
    return spark.createDataFrame(rows, "cell_id long, d date, precip double")


@pytest.mark.parametrize("span", [3, 7, 14, 56])
def test_rolling_windows_do_not_depend_on_the_span(spark, span):
    values = [i * 1.0 if i % 11 else None for i in range(60)]
    got = {r.d: (r.r24, r.r72, r.r7d) for r in rainfall.rolling_windows(daily(spark, values), span=span).collect()}
    start = dt.date(2012, 6, 1)
    for i, v in enumerate(values):
        if v is None:
            assert start + dt.timedelta(i) not in got
            continue

        def total(n):
            part = values[max(0, i - n + 1): i + 1]
            return sum(part) if len(part) == n and None not in part else None

        assert got[start + dt.timedelta(i)] == (v, total(3), total(7))


def test_window_guard_modes(spark):
    d = daily(spark, [1, 2, None, 4, 5, 6, 7])
    ev = spark.createDataFrame([(9, 1, dt.date(2012, 6, 7))], "event_id int, cell_id long, event_date date")
    each = rainfall.antecedent_at(ev, d).first()
    assert (each.r24, each.r72, each.r7d) == (7.0, 18.0, None)
    every = rainfall.antecedent_at(ev, d, complete="all").first()
    assert (every.r24, every.r72, every.r7d) == (None, None, None)
    zero = rainfall.antecedent_at(ev, d, complete="none").first()
    assert zero.r7d == 25.0
    full = rainfall.antecedent_grid(daily(spark, range(1, 8)), "2012-06-07").first()
    assert (full.r24, full.r72, full.r7d) == (7.0, 18.0, 28.0)


def test_positions_and_running_totals_match_a_global_sort(spark):
    rows = [(i * 7919 % 1009, i % 3, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, g int, v long")
    got = sorted((r.k, r.v, r.position) for r in ordering.with_position(df, ["k", "v"], start=5).collect())
    assert [p for _, _, p in got] == list(range(5, 1005))
    run = 0
    for r in sorted(ordering.running_totals(df, ["k", "v"], {"t": F.col("v")}).collect(), key=lambda r: (r.k, r.v)):
        run += r.v
        assert r.t == run


def test_stencil_across_tiles(spark):
    h, w = 9, 11
    z = {(r, c): float((r * 31 + c * 17) % 23) for r in range(h) for c in range(w)}
    z[(4, 4)] = None
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "r int, c int, z double")
    meta = GridMeta(88.0, 27.5, 0.01, 0.01, w, h)
    around = terrain.neighbourhood(cells, meta, tile=4).collect()
    assert len(around) == h * w
    shift = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "o": (0, 0), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
    for row in around:
        for n, (dr, dc) in shift.items():
            key = (min(max(row.r + dr, 0), h - 1), min(max(row.c + dc, 0), w - 1))
            assert row[f"z_{n}"] == z.get(key), (row.r, row.c, n)
    # an absent cell leaves the same gap in the derivatives as a NULL one
    absent = terrain.derivatives(cells.where("z IS NOT NULL"), meta).where("slope IS NULL").count()
    assert (absent, terrain.derivatives(cells, meta).where("slope IS NULL").count()) == (8, 9)


def test_aspect_of_planes(spark):
    meta = GridMeta(88.0, 27.5, 0.001, 0.001, 5, 5)
    for fn, want in ((lambda r, c: -10.0 * c, 90.0), (lambda r, c: 10.0 * c, 270.0), (lambda r, c: 10.0 * r, 0.0), (lambda r, c: -10.0 * r, 180.0)):
        cells = spark.createDataFrame([(r, c, fn(r, c)) for r in range(5) for c in range(5)], "r int, c int, z double")
        mid = terrain.derivatives(cells, meta).where("r = 2 AND c = 2").first()
        assert mid.aspect == pytest.approx(want, abs=1e-6)
        up = terrain.derivatives(cells, meta, direction="upslope").where("r = 2 AND c = 2").first()
        assert abs(up.aspect - mid.aspect) == pytest.approx(180.0)
    flat = spark.createDataFrame([(r, c, 5.0) for r in range(3) for c in range(3)], "r int, c int, z double")
    assert {x.aspect for x in terrain.derivatives(flat, GridMeta(88.0, 27.5, 0.001, 0.001, 3, 3)).collect()} == {-1.0}


def test_point_to_cell_rules_differ_on_borders(spark):
    meta = GridMeta(0.0, 10.0, 1.0, 1.0, 10, 10)
    pts = spark.createDataFrame([(9.3, 0.7), (10.5, 0.7), (9.3, None)], "latitude double, longitude double")
    inside = [(r._r, r._c) for r in spatial.cell_of(pts, meta).collect()]
    assert inside == [(0, 0), (None, 0), (0, None)]
    assert [(r._r, r._c) for r in spatial.cell_of(pts, meta, "rounded").collect()][0] == (1, 1)
    axis = Axis(0.5, 1.0, 10)
    near = spark.createDataFrame([(1.0,), (1.01,), (-9.0,), (99.0,)], "v double").select(spatial.nearest_index(F.col("v"), axis))
    assert [r[0] for r in near.collect()] == [0, 1, 0, 9]


def test_cross_duplicates_count_pairs(spark):
    a = spark.createDataFrame([(1.0, 1.0)] * 3 + [(2.0, 2.0)], "latitude double, longitude double")
    b = spark.createDataFrame([(1.0, 1.0)] * 2 + [(3.0, 3.0)], "latitude double, longitude double")
    r = neighbours_cross(a, b)
    assert (r.pairs, r.shared_keys) == (6, 1)


def neighbours_cross(a, b):
    from hazardspark.operators.neighbours import cross_duplicates

    return cross_duplicates(a, b, ["latitude", "longitude"]).first()


def test_grid_counts_and_children(spark):
    full = grid.make_grid(spark, 27.18, 88.58, 0.001, 171, 201)
    assert full.count() == 34371
    cell = spark.createDataFrame([("COARSE_C00007", 27.2, 88.6, 0.9)], "cell_id string, latitude double, longitude double, susceptibility_prob double")
    kids = grid.subdivide(cell).orderBy("fine_cell_id").collect()
    assert len(kids) == 100 and kids[0].fine_cell_id == "FINE_C00007_001"
    assert (kids[0].latitude, kids[0].longitude) == pytest.approx((27.19955, 88.59955), abs=1e-6)
    assert (kids[99].latitude, kids[99].longitude) == pytest.approx((27.20045, 88.60045), abs=1e-6)


def test_read_table_errors_and_nan(spark):
    with pytest.raises(tables.MissingTable):
        tables.read_table(spark, new_path(spark, "nowhere"), "a int")
    path = new_path(spark, "csv")
    df = spark.createDataFrame([(1, float("nan"), 'a "b", c'), (2, 1.5, None)], "a int, b double, s string")
    tables.write_table(df, path, "csv")
    got = sorted((r.a, r.b, r.s) for r in tables.read_table(spark, path, "a int, b double, s string").collect())
    assert got == [(1, None, 'a "b", c'), (2, 1.5, None)]
    empty = new_path(spark, "csv")
    tables.write_table(df.limit(0), empty, "csv")
    with pytest.raises(tables.EmptyTable):
        tables.read_table(spark, empty, "a int, b double, s string")


def test_geojson_round_trip_and_collection(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 27.5, 88.5), (2, None, 27.6, 88.6)], "id int, name string, latitude double, longitude double")
    lines = [json.loads(r.value) for r in tables.to_geojson(df).collect()]
    assert lines[1]["properties"] == {"id": 2, "name": None}
    assert lines[0]["geometry"]["coordinates"] == [88.5, 27.5]
    whole = tmp_path / "c.geojson"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": lines}, indent=2))
    back = tables.read_features(spark, str(whole), "id int, name string", lines=False)
    assert sorted(tuple(r) for r in back.collect()) == [(27.5, 88.5, 1, "x"), (27.6, 88.6, 2, None)]


def test_fragments_with_and_without_header(spark):
    rows = [(1, 0, ["Sl.No", "name"]), (1, 1, ["1", "a"]), (2, 0, ["name", "slide_no"]), (2, 1, ["b", "7"]), (3, 0, ["only"]),
            (4, 0, ["p", "q"]), (4, 1, ["r", "s"])]
    merged = tables.merge_fragments(spark.createDataFrame(rows, "fragment int, row_no long, cells array<string>"))
    got = {(r.fragment, r.row_no): {k: v for k, v in r.asDict().items() if v is not None and k not in ("fragment", "row_no")} for r in merged.collect()}
    assert got == {(1, 1): {"Sl.No": "1", "name": "a"}, (2, 1): {"name": "b", "slide_no": "7"},
                   (4, 0): {"0": "p", "1": "q"}, (4, 1): {"0": "r", "1": "s"}}


def test_cleaning(spark):
    df = spark.createDataFrame([(" a\n b ", "None"), (None, "nan"), ("x", "y")], "t string, u string")
    assert [tuple(r) for r in quality.normalize_text(df).collect()] == [("a b", ""), ("", ""), ("x", "y")]
    pts = spark.createDataFrame([("27.1", "88"), ("1e9", "88"), ("12d", "88"), ("NaN", "88"), (None, "88")], "latitude string, longitude string")
    assert [tuple(r) for r in quality.valid_coords(pts).collect()] == [(27.1, 88.0)]
    roles = quality.detect_roles(spark.createDataFrame([(27.0, 88.0, 1)], "p double, q double, n int"))
    assert roles["latitude"] == ["p"] and roles["longitude"] == ["q"]
    assert quality.detect_roles(spark.createDataFrame([(1.0, 1.0)], "start_lat double, relatlong double"))["latitude"] == ["start_lat"]


def test_daily_grid_dates_and_fill(spark):
    df = spark.createDataFrame([(0, 1.0), (11846, -9999.0)], "t int, precip double")
    got = [(r.d, r.precip, r.year, r.month) for r in raster.daily_grid(df).collect()]
    assert got == [(dt.date(1980, 1, 1), 1.0, 1980, 1), (dt.date(2012, 6, 7), None, 2012, 6)]


def test_auc_and_ap_with_ties(spark):
    rows = [(1, 0.8), (0, 0.8), (1, 0.6), (0, 0.4), (1, 0.4), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, prob double")
    pos, neg = [p for l, p in rows if l], [p for l, p in rows if not l]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(want)
    ap, seen, tp = 0.0, 0, 0
    for p in sorted({p for _, p in rows}, reverse=True):
        hits = sum(1 for l, q in rows if q == p and l)
        seen, tp = seen + sum(1 for _, q in rows if q == p), tp + hits
        ap += hits / len(pos) * tp / seen
    assert metrics.average_precision(df).first().average_precision == pytest.approx(ap)
    zero = metrics.confusion(df.where("label = 0"), 0.9).first()
    assert (zero.precision, zero.recall, zero.f1) == (0.0, 0.0, 0.0)


def test_kfold_balances_whole_groups(spark):
    rows = [(g, i) for g, n in enumerate([50, 40, 30, 20, 10, 5, 5]) for i in range(n)]
    out = dataset.group_kfold(spark.createDataFrame(rows, "g int, i int"), "g", 3)
    sizes = {r.fold: r["count"] for r in out.groupBy("fold").count().collect()}
    assert out.select("g", "fold").distinct().count() == 7 and sizes == {0: 55, 1: 55, 2: 50}


def test_feed_semantics(spark):
    df = spark.createDataFrame([(i, "High" if i % 2 else "Low") for i in range(20)], "cell_id int, risk_tier string")
    got = feeds.q_coarse(df, ["cell_id"], sample_step=3, limit=4, tier="high")
    assert sorted(r.cell_id for r in got.collect()) == [3, 9]
    assert feeds.q_coarse(df, ["cell_id"], district="x").count() == 0
    wide = spark.createDataFrame([(1, 0.1, 0.2, "Low")], ["cell_id", "ridx_+6h", "risk_+6h", "tier_+6h"])
    for text in (" 6h", "+6h", "6h", "+6h "):
        assert feeds.q_forecast(wide, ["cell_id"], horizon=text).first().forecast_horizon == "+6h"
    with pytest.raises(ValueError):
        feeds.q_forecast(wide, ["cell_id"], horizon="+9h")
    assert feeds.available_horizons(wide) == ["+6h"]
    assert feeds.q_attribution(spark, new_path(spark, "none")).columns == ["error", "status"]


def test_substring_rules(spark):
    feed = spark.createDataFrame([("HIGH",), ("VERY HIGH",), (None,)], "alert_severity string")
    assert dashboard.severity_contains(feed, "HIGH").count() == 2
    assert feeds.q_alerts(feed, "HIGH").count() == 1
    tiers = spark.createDataFrame([("Very High",), ("high",), ("odd",), (None,)], "risk_tier string")
    assert {r.name: r["count"] for r in dashboard.tier_distribution(tiers).collect()} == {"LOW": 2, "MODERATE": 0, "HIGH": 1, "VERY HIGH": 1}


def test_plan_dispatch_modes(spark):
    rows = [(1, "A", "+6h", "HIGH", "FAILED"), (2, "A", "+6h", "HIGH", "SENT"), (3, "A", "+6h", "HIGH", "SENT"),
            (4, "B", "+6h", "HIGH", "DISABLED"), (5, "C", "+6h", "HIGH", "SENT"), (6, "D", "+6h", "HIGH", "SENT"), (7, "K", "+6h", "HIGH", "SENT")]
    feed = spark.createDataFrame(rows, "pos int, location_id string, forecast_horizon string, alert_severity string, outcome string")
    ledger = spark.createDataFrame([("K", "+6h", "HIGH")], "location_id string, forecast_horizon string, alert_severity string")
    known = {r.pos: r.status for r in alerts.plan_dispatch(feed, ledger, ["pos"], 2, "outcome").collect()}
    assert known == {1: "FAILED", 2: "SENT", 3: "SKIPPED_DUPLICATE", 4: "DISABLED", 5: "SENT", 6: "DEFERRED", 7: "DEFERRED"}
    plan = {r.pos: r.status for r in alerts.plan_dispatch(feed, ledger, ["pos"], 2).collect()}
    assert plan == {1: "PLANNED", 2: "SKIPPED_DUPLICATE", 3: "SKIPPED_DUPLICATE", 4: "PLANNED", 5: "DEFERRED", 6: "DEFERRED", 7: "DEFERRED"}
    alls = {r.pos: r.status for r in alerts.plan_dispatch(feed, ledger, ["pos"], 9).collect()}
    assert alls[7] == "SKIPPED_DUPLICATE" and alls[6] == "PLANNED"


def test_enrichment_and_bounds(spark):
    box = Box(0.0, 1.0, 0.0, 1.0)
    pts = spark.createDataFrame([(0.0, 1.0), (0.5, 2.0), (None, 0.5)], "latitude double, longitude double")
    r = spatial.coverage(pts, box).first()
    assert (r.points, r.inside, r.outside) == (3, 1, 2) and math.isclose(r.pct_inside, 100 / 3)


def test_folds_are_those_of_the_rule_one_group_at_a_time(spark):
    import random

    rnd = random.Random(6)
    for k, counts in ((3, [1] * 40), (5, [rnd.choice([1, 1, 1, 2, 3, 50, 7]) for _ in range(200)]), (4, [9, 2]), (2, [1000] + [1] * 700)):
        rows = [(g, i) for g, n in enumerate(counts) for i in range(n)]
        out = dataset.group_kfold(spark.createDataFrame(rows, "g int, i int"), "g", k)
        assert "collect_list" not in out._jdf.queryExecution().toString()
        loads, want = [0] * k, {}
        for n, g in sorted(((n, g) for g, n in enumerate(counts)), key=lambda p: (-p[0], p[1])):
            want[g] = loads.index(min(loads))
            loads[want[g]] += n
        got = out.collect()
        assert len(got) == len(rows) and {r.g: r.fold for r in got} == want


def test_cleaning_counts_fall_out_of_the_write(spark):
    ddl = "district string, latitude string, longitude string, `a.b` double"
    rows = [("x", "1.0", "2.0", 1.0)] * 40 + [("x", "1.00", "2.0", 1.0), ("y", "91", "2", None), (None, None, None, None), ("z", None, "3", None)]
    for table in (spark.createDataFrame(rows, ddl).repartition(4), spark.createDataFrame([], ddl)):
        path = new_path(spark, "clean")
        report = quality.clean_to(table, path)
        want = quality.cleaning_report(table).first()
        assert report.first() == want
        assert spark.read.parquet(path).count() == want.clean_rows
    assert want.input_rows == 0
