"""Training set, model and metric queries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hazardspark.functions.numeric import nan_to_null
from hazardspark.operators import boosting, dataset, ensembles, grid, metrics, models, spatial, terrain
from hazardspark.plans.grid import WIDE, coarse
from hazardspark.plans.registry import query
from hazardspark.plans.spatial import CANDIDATES, COL, DD, DM, ROW, STACK, candidates, stacked
from hazardspark.plans.tables import cells_meta
from hazardspark.plans.terrain import STENCIL, base
from hazardspark.session import materialize
from hazardspark.sources.raster import raster_cells

RAIN = "rain AS (SELECT cell_id AS sl_no, r24, r72, r7d FROM fx_scored)"
POS = f"""
, {STACK}, {RAIN}
, pos AS (SELECT 'LS_' || CAST(p.sl_no AS VARCHAR) AS sample_id, 1 AS label,
    CASE WHEN r24 IS NOT NULL THEN 'dated_event_positive' ELSE 'baseline_inventory_positive' END AS sample_type, r24 IS NOT NULL AS is_dated,
    p.sl_no, p.slide_name, p.district, p.material, p.latitude, p.longitude, r24, r72, r7d, clay, sand, silt, bulk_density, z, land_cover
  FROM fx_points p LEFT JOIN rain USING (sl_no) LEFT JOIN fx_soil USING (sl_no) LEFT JOIN stacked USING (sl_no) WHERE p.label = 1)
, neg AS (SELECT 'BG_' || CAST(sl_no AS VARCHAR) AS sample_id, 0 AS label, 'background_negative' AS sample_type, FALSE AS is_dated, latitude, longitude, district, z, land_cover
  FROM fx_points JOIN stacked USING (sl_no) WHERE label = 0)
, ml AS (SELECT * FROM pos UNION ALL BY NAME SELECT * FROM neg)
"""
VIEWS = "fx_points fx_cells fx_soil fx_scored"


def positives(t):
    rain = t.fx_scored.select(F.col("cell_id").alias("sl_no"), "r24", "r72", "r7d")
    layers = stacked(t).select("sl_no", "z", "land_cover")
    return dataset.positives(t.fx_points.where(F.col("label") == 1), rain, t.fx_soil, layers)


def ml_data(t):
    layers = stacked(t).where(F.col("label") == 0)
    neg = layers.select(
        F.concat(F.lit("BG_"), F.col("sl_no").cast("string")).alias("sample_id"), F.lit(0).alias("label"),
        F.lit("background_negative").alias("sample_type"), F.lit(False).alias("is_dated"),
        "latitude", "longitude", "district", "z", "land_cover")
    return dataset.ml_dataset(positives(t), neg)


@query("k1_positives", VIEWS, POS + "SELECT * FROM pos")
def k1(t):
    return positives(t)


def _nearest(n):
    """The ``n`` inventory points nearest to each spaced cell."""
    return (f"SELECT a.rn, b.district, b.bulk_density, {DD} AS dist FROM spaced a JOIN inv b ON TRUE "
            f"QUALIFY row_number() OVER (PARTITION BY a.rn ORDER BY {DD}, b.sl_no) <= {n}")


# the sequential rule: walk the cells far from the inventory by rank, keep the spaced ones
NEGATIVES = f"""
, inv AS (SELECT p.*, p.longitude * 98500e0 AS x, p.latitude * 111000e0 AS y, s.bulk_density FROM fx_points p JOIN fx_soil s ON s.sl_no = p.sl_no WHERE p.label = 1)
, fit AS (SELECT r, c, z, 27.83e0 - (r + 0.5e0) * 0.02e0 AS latitude, 88.05e0 + (c + 0.5e0) * 0.016e0 AS longitude FROM fx_cells
    WHERE (r, c) IN ({CANDIDATES}))
, o AS (SELECT a.*, row_number() OVER (ORDER BY md5('42|' || r || '|' || c), r, c) AS rn FROM (SELECT *, longitude * 98500e0 AS x, latitude * 111000e0 AS y FROM fit) a
    WHERE NOT EXISTS (SELECT 1 FROM inv b WHERE {DM} < 1000e0))
, walk AS (SELECT 0::BIGINT AS rn, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS kept
  UNION ALL SELECT o.rn, CASE WHEN len(list_filter(kept, lambda k: sqrt((k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y)) < 2000e0)) = 0
    THEN list_append(kept, {{'id': o.rn, 'x': o.x, 'y': o.y}}) ELSE kept END FROM walk JOIN o ON o.rn = walk.rn + 1)
, spaced AS (SELECT o.* FROM (SELECT unnest(kept) AS k FROM (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1) w) u JOIN o ON o.rn = k.id
    ORDER BY o.rn LIMIT (SELECT count(*) FROM inv))
, named AS ({_nearest(1)})
, five AS ({_nearest(5)})
, mean AS (SELECT rn, sum(bulk_density / greatest(dist, 1e-6)) / sum(1e0 / greatest(dist, 1e-6)) AS bulk_density FROM five GROUP BY rn)
SELECT printf('BG_%04d', row_number() OVER (ORDER BY spaced.rn)) AS sample_id, 0 AS label, 'background_negative' AS sample_type, FALSE AS is_dated,
  round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, z AS elevation, named.district, CAST(round_even(mean.bulk_density, 0) AS INTEGER) AS bulk_density
FROM spaced JOIN named ON named.rn = spaced.rn JOIN mean ON mean.rn = spaced.rn"""


@query("k2_negatives", "fx_points fx_cells fx_soil", NEGATIVES, recursive=True)
def k2(t):
    """Cells 1 km off the inventory and 2 km apart, in an order that SQL can repeat."""
    rank = F.md5(F.concat_ws("|", F.lit("42"), F.col("r").cast("string"), F.col("c").cast("string")))
    inventory = t.fx_points.where(F.col("label") == 1).join(t.fx_soil.select("sl_no", "bulk_density"), "sl_no")
    cells = candidates(t).withColumn("rank", rank).select("r", "c", "latitude", "longitude", "elevation", "rank")
    out = dataset.negatives(cells, inventory, spacing=2000.0, interpolate="bulk_density")
    return out.withColumns({c: F.round(c, 9) for c in ("latitude", "longitude")})


@query("k3_ml_dataset", VIEWS, POS + "SELECT * FROM ml")
def k3(t):
    return ml_data(t)


@query("k4_ml_qa", VIEWS, POS + f"""
, m AS (SELECT *, longitude * 98500e0 AS x, latitude * 111000e0 AS y FROM ml)
, near AS (SELECT a.sample_id, min({DM}) AS d FROM m a JOIN m b ON a.label = 0 AND b.label = 1 GROUP BY a.sample_id)
SELECT (SELECT count(*) FROM ml) AS total, (SELECT count(*) FROM pos) AS positives, (SELECT count(*) FROM neg) AS negatives,
  (SELECT count(*) FROM ml WHERE is_dated) AS dated,
  (SELECT count(*) - count(DISTINCT (latitude, longitude)) FROM pos) AS positive_duplicates,
  (SELECT count(*) - count(DISTINCT (latitude, longitude)) FROM neg) AS negative_duplicates,
  (SELECT count(*) FROM pos JOIN neg USING (latitude, longitude)) AS cross_duplicates,
  (SELECT round(min(d), 6) FROM near) AS min_buffer_m, (SELECT count(*) FROM near WHERE d < 1000) AS leakage_violations""")
def k4(t):
    return dataset.ml_qa(ml_data(t)).withColumn("min_buffer_m", F.round("min_buffer_m", 6))


BLOCKS = """
, b AS (SELECT min(latitude) - 1e-5 AS la, max(latitude) + 1e-5 AS lz, min(longitude) - 1e-5 AS oa, max(longitude) + 1e-5 AS oz FROM fx_points)
, blocks AS (SELECT p.*, longitude * 98500e0 AS x, latitude * 111000e0 AS y,
    CAST(greatest(least(CAST(ceil((latitude - la) / ((lz - la) / 5e0)) AS INTEGER) - 1, 4), 0) AS VARCHAR) || '_'
    || CAST(greatest(least(CAST(ceil((longitude - oa) / ((oz - oa) / 5e0)) AS INTEGER) - 1, 4), 0) AS VARCHAR) AS spatial_block FROM fx_points p, b)
"""
SPLIT = BLOCKS + """
, grp AS (SELECT spatial_block, row_number() OVER (ORDER BY md5('42|' || spatial_block), spatial_block) <= ceil((SELECT count(DISTINCT spatial_block) FROM blocks) * 0.2) AS is_test
  FROM (SELECT DISTINCT spatial_block FROM blocks) d)
, split AS (SELECT blocks.*, is_test FROM blocks JOIN grp USING (spatial_block))
"""


def split(t):
    blocks = dataset.spatial_blocks(spatial.local_metres(t.fx_points))
    order = F.md5(F.concat(F.lit("42|"), F.col("spatial_block")))
    return dataset.group_holdout(blocks, "spatial_block", shuffle=order)


@query("k5_spatial_blocks", "fx_points", BLOCKS + "SELECT sl_no, spatial_block FROM blocks")
def k5(t):
    return dataset.spatial_blocks(t.fx_points).select("sl_no", "spatial_block")


@query("k6_group_holdout", "fx_points", SPLIT + "SELECT sl_no, spatial_block, is_test FROM split")
def k6(t):
    return split(t).select("sl_no", "spatial_block", "is_test")


@query("k6_buffered_train", "fx_points", SPLIT + f"""
SELECT sl_no, is_test FROM split a WHERE is_test OR NOT EXISTS (SELECT 1 FROM split b WHERE b.is_test AND {DM} < 2000e0)""")
def k6_buffer(t):
    return dataset.buffered_train(split(t), "sl_no", 2000.0).select("sl_no", "is_test")


@query("k7_group_kfold", "fx_predictions", """
, g AS (SELECT block, n, row_number() OVER (ORDER BY n DESC, block) AS rn FROM (SELECT block, count(*) AS n FROM fx_predictions GROUP BY block) x)
, f AS (SELECT 0::BIGINT AS rn, [0::BIGINT, 0, 0, 0, 0] AS loads, -1 AS block, -1 AS fold
  UNION ALL SELECT g.rn, list_transform(f.loads, lambda v, i: CASE WHEN i = list_position(f.loads, list_min(f.loads)) THEN v + g.n ELSE v END), g.block,
    CAST(list_position(f.loads, list_min(f.loads)) AS INTEGER) - 1 FROM f JOIN g ON g.rn = f.rn + 1)
SELECT p.id, p.block, f.fold FROM fx_predictions p JOIN f USING (block)""", recursive=True)
def k7(t):
    return dataset.group_kfold(t.fx_predictions, "block").select("id", "block", "fold")


NUMERIC = ("z", "slope", "aspect", "curvature", "clay", "sand", "silt", "bulk_density")
MODEL = dict(numeric=NUMERIC, categorical=("land_cover",))
# fixed values: trees and rounds of the validation runs
FITS = {
    "logistic": models.Fit(models.fit_logistic),
    "forest": models.Fit(models.fit_forest, {"trees": 100}),
    "boosted": models.Fit(models.fit_boosted, {"rounds": 100, "key": "sl_no"}, models.fit_boosted_many),
}
CODES = (10, 30, 50, 60, 80)


def samples(t):
    """Points with terrain, soil and land cover, in local metres and spatial blocks."""
    meta = cells_meta(t)
    layers = dict.fromkeys(("z", "slope", "aspect", "curvature"), -9999.0)
    cells = terrain.derivatives(base(t), meta).join(base(t).select("r", "c", "land_cover"), ["r", "c"])
    points = t.fx_points.select("sl_no", "label", "latitude", "longitude")
    points = spatial.stack_layers(points, cells, meta, {**layers, "land_cover": None}).join(t.fx_soil, "sl_no")
    points = points.withColumn("land_cover", F.col("land_cover").cast("string"))
    return dataset.spatial_blocks(spatial.local_metres(points))


def holdout(t):
    """Training rows at least 500 m from every test row, and the test rows."""
    order = F.md5(F.concat(F.lit("42|"), F.col("spatial_block")))
    data = materialize(dataset.group_holdout(samples(t), "spatial_block", shuffle=order), "holdout")
    data = materialize(dataset.buffered_train(data, "sl_no"), "buffered")
    return data.where(~F.col("is_test")).drop("is_test"), data.where("is_test").drop("is_test")


def _scored(t, fit, **kw):
    train, test = holdout(t)
    return models.score(test, fit(train, **MODEL, **kw)).select("sl_no", "label", F.round("prob", 6).alias("prob"))


def _same(one, other):
    """True where both are the same up to rounding, NULL where both are missing."""
    return F.when(one.isNull() & other.isNull(), F.lit(None)).otherwise(F.coalesce(F.abs(one - other) < 1e-9, F.lit(False)))


ALL_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in NUMERIC)
SAMPLE = STENCIL + f"""
, sample AS (SELECT p.sl_no, k.z, k.slope, k.aspect, k.curvature, m.land_cover, clay, sand, silt, bulk_density
  FROM (SELECT *, {ROW} AS r, {COL} AS c FROM fx_points) p JOIN fx_soil s ON s.sl_no = p.sl_no
  LEFT JOIN terrain k ON k.r = p.r AND k.c = p.c LEFT JOIN fx_cells m ON m.r = p.r AND m.c = p.c)
, fitted AS (SELECT {", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in NUMERIC)} FROM sample WHERE {ALL_KNOWN})
"""


@query("k8_prep_pipeline", "fx_points fx_cells fx_soil", SAMPLE + "SELECT sl_no, " + ", ".join(
    f"round((s.{c} - {c}_mean) / {c}_std, 6) AS f{i}" for i, c in enumerate(NUMERIC)) + ", " + ", ".join(
    f"CASE WHEN land_cover = {code} THEN 1e0 ELSE 0e0 END AS f{8 + i}" for i, code in enumerate(CODES)) + " FROM sample s CROSS JOIN fitted")
def k8(t):
    data = materialize(samples(t), "samples")
    known = data.where(models.complete(NUMERIC))
    ready = models.prep_pipeline(known.count(), **MODEL).fit(known).transform(data)
    ready = ready.withColumn("_f", vector_to_array("features"))
    return ready.select("sl_no", *[F.round(nan_to_null(F.col("_f")[i]), 6).alias(f"f{i}") for i in range(13)])


@query("k8_missing_features", "fx_points fx_cells fx_soil", SAMPLE + f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE NOT ({ALL_KNOWN})) AS without_score FROM sample""")
def k8_missing(t):
    return models.missing_features(samples(t), NUMERIC)


@query("k9_fit_logistic")
def k9(t):
    return _scored(t, models.fit_logistic)


@query("k9_gradient", sql="SELECT unnest(['intercept', " + ", ".join(
    [f"'num__{c}'" for c in NUMERIC] + [f"'cat__land_cover_{c}'" for c in CODES]) + "]) AS feature, TRUE AS at_optimum")
def k9_gradient(t):
    """The loss is flat at the fitted coefficients, so they are those of the ridge model."""
    data = materialize(samples(t), "samples")
    flat = models.penalised_gradient(data, models.fit_logistic(data, **MODEL), **MODEL)
    return flat.select("feature", (F.abs("gradient") < 1e-4).alias("at_optimum"))


HELD_OUT = SAMPLE + SPLIT + f"""
SELECT split.sl_no, label, {ALL_KNOWN} AS scored, CASE WHEN {ALL_KNOWN} THEN TRUE END AS same_prob
FROM split JOIN sample ON sample.sl_no = split.sl_no WHERE is_test"""


def _checked(df, own, walked):
    return df.select("sl_no", "label", F.col(own).isNotNull().alias("scored"), _same(F.col(own), F.col(walked)).alias("same_prob"))


@query("k10_fit_forest", "fx_points fx_cells fx_soil", HELD_OUT)
def k10(t):
    """Held-out rows scored by the forest and by walking its nodes."""
    train, test = holdout(t)
    forest = models.fit_forest(train, **MODEL)
    return _checked(models.walked_probability(models.score(test, forest), forest), "prob", "walked")


def _boosted(t):
    """Boosting on the training part, and the held-out part."""
    train, test = holdout(t)
    return models.fit_boosted(train, key="sl_no", **MODEL), train, test


@query("k11_fit_boosted", "fx_points fx_cells fx_soil", HELD_OUT)
def k11(t):
    """Held-out rows scored by walking the nodes and by the bins that the fit itself uses."""
    model, _, test = _boosted(t)
    own = boosting.binned_margins(test, model, "sl_no").withColumn("own", 1 / (1 + F.exp(-F.col("margin"))))
    return _checked(models.score(test, model).join(own, "sl_no", "left"), "own", "prob")


@query("k11_best_splits", "", "SELECT unnest([0, 30]) AS tree, TRUE AS all_best, TRUE AS loss_falls")
def k11_splits(t):
    """Every split of a tree has the best gain of its histogram, and the loss falls in every round."""
    train, _ = holdout(t)
    settings = boosting.Settings(rounds=31)
    model = boosting.fit(train, key="sl_no", settings=settings, **MODEL)
    falls = all(b < a for a, b in zip(model.losses, model.losses[1:]))
    out = None
    for tree in (0, 30):
        audit = boosting.split_audit(train, model, tree, "label", "sl_no", settings)
        best = F.abs(F.col("gain") - F.col("best")) <= 1e-6 * F.col("best")
        part = audit.agg(F.coalesce(F.bool_and(best), F.lit(False)).alias("all_best")).select(
            F.lit(tree).alias("tree"), "all_best", F.lit(falls).alias("loss_falls"))
        out = part if out is None else out.unionByName(part)
    return out


@query("k12_score", "fx_points fx_cells fx_soil", SAMPLE + f"""
SELECT sl_no, m.model, {ALL_KNOWN} AS scored, CASE WHEN {ALL_KNOWN} THEN TRUE END AS same_prob
FROM sample CROSS JOIN (SELECT unnest(['logistic', 'forest']) AS model) m""")
def k12(t):
    """All samples by the fitted models, beside their formula and their nodes."""
    data = materialize(samples(t), "samples")
    linear, forest = models.fit_logistic(data, **MODEL), models.fit_forest(data, trees=50, **MODEL)
    terms, intercept = models.linear_terms(linear, **MODEL)
    values = models.transformed(data, linear, **MODEL)
    logit = reduce(lambda s, c: s + F.col(c[0]) * F.lit(c[1]), terms.items(), F.lit(intercept))
    formula = values.select("sl_no", (1 / (1 + F.exp(-logit))).alias("walked"))
    both = {"logistic": models.score(data, linear).join(formula, "sl_no", "left"),
            "forest": models.walked_probability(models.score(data, forest), forest)}
    parts = [
        df.select("sl_no", F.lit(name).alias("model"), F.col("prob").isNotNull().alias("scored"),
                  _same(F.col("prob"), F.col("walked")).alias("same_prob")) for name, df in both.items()]
    return parts[0].unionByName(parts[1])


COUNTS = """count(*) FILTER (WHERE prob >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE prob >= {t} AND label = 0) AS fp,
  count(*) FILTER (WHERE prob < {t} AND label = 1) AS fn, count(*) FILTER (WHERE prob < {t} AND label = 0) AS tn"""
SCORES = """round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 9) AS precision,
  round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 9) AS f1"""
NAMES = ("accuracy", "precision", "recall", "f1")


def _r9(df, cols=NAMES):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("k13_confusion", "fx_predictions", f", n AS (SELECT {COUNTS.format(t='0.5::DOUBLE')} FROM fx_predictions) SELECT *, {SCORES} FROM n")
def k13(t):
    return _r9(metrics.confusion(t.fx_predictions))


@query("k14_roc_auc", "fx_predictions", """
, s AS (SELECT prob, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM fx_predictions GROUP BY prob)
, c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT round(sum(pos * (below + neg / 2e0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 9) AS roc_auc FROM c""")
def k14(t):
    return _r9(metrics.roc_auc(t.fx_predictions), ["roc_auc"])


@query("k15_average_precision", "fx_predictions", """
, s AS (SELECT prob, count(*) FILTER (WHERE label = 1) AS pos, count(*) AS n FROM fx_predictions GROUP BY prob)
, c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (ORDER BY prob DESC))
SELECT round(sum(CAST(pos AS DOUBLE) * tp / seen) / sum(pos), 9) AS average_precision FROM c""")
def k15(t):
    return _r9(metrics.average_precision(t.fx_predictions), ["average_precision"])


@query("k16_brier", "fx_predictions", "SELECT round(avg((prob - label) * (prob - label)), 9) AS brier FROM fx_predictions")
def k16(t):
    return _r9(metrics.brier(t.fx_predictions), ["brier"])


@query("k17_calibration", "fx_predictions", """
SELECT CAST(greatest(ceil(prob * 8) - 1, 0) AS INTEGER) AS bin, count(*) AS n, round(avg(prob), 9) AS prob_pred, round(avg(label), 9) AS prob_true
FROM fx_predictions GROUP BY 1""")
def k17(t):
    return _r9(metrics.calibration(t.fx_predictions), ["prob_pred", "prob_true"])


SWEEP = f"""
, th AS (SELECT round(0.10::DOUBLE + 0.05::DOUBLE * i, 2) AS threshold FROM (SELECT unnest(range(0, 17)) AS i) x)
, n AS (SELECT threshold, {COUNTS.format(t='threshold')} FROM fx_predictions CROSS JOIN th GROUP BY threshold)
, sweep AS (SELECT *, {SCORES} FROM n)
"""


@query("k18_threshold_sweep", "fx_predictions", SWEEP + "SELECT * FROM sweep")
def k18(t):
    return _r9(metrics.threshold_sweep(t.fx_predictions))


@query("k19_threshold_lookup", "fx_predictions", SWEEP + "SELECT * FROM sweep WHERE threshold = 0.35::DOUBLE")
def k19(t):
    return _r9(metrics.threshold_lookup(metrics.threshold_sweep(t.fx_predictions)))


@query("k19_best_threshold", "fx_predictions", SWEEP + "SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1")
def k19_best(t):
    return _r9(metrics.best_threshold(metrics.threshold_sweep(t.fx_predictions)))


ERRORS = """
, e AS (SELECT p.id, p.label, p.prob, x.slope, x.s, CAST(10 * (1 + p.id % 5) AS INTEGER) AS land_cover,
    CASE WHEN prob >= 0.35::DOUBLE THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome
  FROM fx_predictions p JOIN fx_scored x ON x.cell_id = p.id)
"""


def errors(t):
    terrain = t.fx_scored.select(F.col("cell_id").alias("id"), "slope", "s")
    joined = t.fx_predictions.join(terrain, "id")
    return joined.withColumn("land_cover", (10 * (1 + F.col("id") % 5)).cast("int"))


@query("k20_error_analysis", "fx_predictions fx_scored", ERRORS + """
SELECT outcome, count(*) AS n, round(avg(slope), 8) AS slope_mean, min(slope) AS slope_min, max(slope) AS slope_max,
  round(avg(s), 8) AS s_mean, min(s) AS s_min, max(s) AS s_max FROM e GROUP BY outcome""")
def k20(t):
    out = metrics.error_analysis(errors(t), ["slope", "s"])
    return out.withColumns({c: F.round(c, 8) for c in ("slope_mean", "s_mean")})


@query("k20_error_classes", "fx_predictions fx_scored", ERRORS + "SELECT outcome, land_cover, count(*) AS n FROM e WHERE outcome IN ('FN', 'FP') GROUP BY 1, 2")
def k20_classes(t):
    return metrics.error_classes(errors(t), "land_cover")


FOLDS = """
, folds AS (SELECT block, count(*) FILTER (WHERE (prob >= 0.5::DOUBLE) = (label = 1)) / CAST(count(*) AS DOUBLE) AS accuracy, avg((prob - label) * (prob - label)) AS brier
  FROM fx_predictions GROUP BY block)
, scores AS (SELECT 'model_' || CAST(block % 3 AS VARCHAR) AS model, 'accuracy' AS metric, accuracy AS value FROM folds
  UNION ALL SELECT 'model_' || CAST(block % 3 AS VARCHAR), 'brier', brier FROM folds)
"""


def fold_scores(t):
    """Eight blocks for each of three stand-in models."""
    right = F.count_if((F.col("prob") >= 0.5) == (F.col("label") == 1)) / F.count(F.lit(1))
    gap = F.col("prob") - F.col("label")
    folds = t.fx_predictions.groupBy("block").agg(right.alias("accuracy"), F.avg(gap * gap).alias("brier"))
    model = F.concat(F.lit("model_"), (F.col("block") % 3).cast("string"))
    return folds.withColumn("model", model).unpivot("model", ["accuracy", "brier"], "metric", "value")


@query("k21_cv_summary", "fx_predictions", FOLDS + "SELECT model, metric, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std FROM scores GROUP BY 1, 2")
def k21(t):
    out = metrics.cv_summary(fold_scores(t), None)
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "std")})


@query("k22_seed_stability")
def k22(t):
    data = materialize(samples(t), "samples")
    out = models.seed_stability(data, "spatial_block", "sl_no", [42, 101, 777, 999, 2024], FITS, **MODEL)
    return out.withColumn("roc_auc", F.round("roc_auc", 4))


@query("k23_feature_ranking", "", "SELECT m.model, f.feature, TRUE AS same_value FROM (SELECT unnest(["
       + ", ".join([f"'{c}'" for c in NUMERIC] + [f"'land_cover_{c}'" for c in CODES])
       + "]) AS feature) f CROSS JOIN (SELECT unnest(['logistic', 'forest', 'boosted']) AS model) m")
def k23(t):
    """The ranking of each model beside its own figures, summed up from nodes or taken from its formula."""
    data = materialize(samples(t), "samples")
    linear, forest = models.fit_logistic(data, **MODEL), models.fit_forest(data, trees=50, **MODEL)
    boosted = models.fit_boosted(data, rounds=30, key="sl_no", **MODEL)
    terms = [(n.split("__", 1)[1], w) for n, w in models.linear_terms(linear, **MODEL)[0].items()]
    gains = {}
    for _, _, f, _, _, _, gain, _, _ in boosted.nodes:
        if f >= 0:
            gains.setdefault(boosted.names[f], []).append(gain)
    means = {n: sum(gains[n]) / len(gains[n]) if n in gains else 0.0 for n in boosted.names}
    shares = [(n, m / sum(means.values())) for n, m in means.items()]
    others = {
        "logistic": (linear, t.spark.createDataFrame(terms, "feature string, own double")),
        "forest": (forest, ensembles.importances(
            ensembles.forest_nodes(forest, t.spark), models.feature_names(forest, **MODEL)).withColumnRenamed("value", "own")),
        "boosted": (boosted, t.spark.createDataFrame(shares, "feature string, own double")),
    }
    parts = [
        models.feature_ranking(t.spark, model, **MODEL).join(own, "feature", "full").select(
            F.lit(name).alias("model"), "feature", _same(F.col("value"), F.col("own")).alias("same_value"))
        for name, (model, own) in others.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("k24_select_best", "fx_predictions", FOLDS + """
SELECT model, round(avg(value), 8) AS mean FROM scores WHERE metric = 'accuracy' GROUP BY model ORDER BY avg(value) DESC, model LIMIT 1""")
def k24(t):
    means = metrics.cv_summary(fold_scores(t).where(F.col("metric") == "accuracy"), None)
    return metrics.select_best(means, "mean", "model").select("model", F.round("mean", 8).alias("mean"))


@query("k7_cross_validate")
def k7_validate(t):
    """Grouped cross-validation of the three models with a 500 m buffer, summarised per metric."""
    scores = models.cross_validate(materialize(samples(t), "samples"), "spatial_block", "sl_no", FITS, **MODEL)
    return metrics.cv_summary(scores)


FEATURES = dict(numeric=("z", "bulk_density"), categorical=("land_cover",))


@query("g8_refine_with_model")
def g8_model(t):
    """Children of flagged cells: features sampled again, scored by a fitted model.

    A child without some feature stays, with a NULL score.
    """
    meta = cells_meta(t)
    soil = t.fx_points.select("sl_no", "latitude", "longitude", "label").join(t.fx_soil.select("sl_no", "bulk_density"), "sl_no")
    layers = {"z": -9999.0, "land_cover": None}
    train = spatial.stack_layers(soil, t.fx_cells, meta, layers)
    model = models.fit_logistic(train.withColumn("land_cover", F.col("land_cover").cast("string")), **FEATURES)
    parents = grid.focal_parents(coarse(t), WIDE)
    kids = grid.resample(grid.subdivide(parents), t.fx_cells, meta, layers, soil, "bulk_density")
    kids = kids.withColumn("land_cover", F.col("land_cover").cast("string"))
    return grid.refine(models.score(kids, model, "p")).select(
        "fine_cell_id", "parent_susceptibility", "fine_susceptibility", "risk_delta", "micro_risk_tier")
