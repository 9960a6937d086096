"""Attribution queries: a fixed linear model on eight embedding columns, and the fitted one."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardspark.operators import attribution as attr
from hazardspark.operators import models
from hazardspark.plans import modeling
from hazardspark.plans.registry import query
from hazardspark.session import materialize

FEATURES = [n for n in attr.LABELS if n.startswith("num__")]
COEF = dict(zip(FEATURES, (-1.6, 1.2, 0.3, -0.45, 0.7, -0.25, 0.15, -0.9)))
INTERCEPT = 0.2
COLS = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(FEATURES))
LOGIT = " + ".join([f"{INTERCEPT}::DOUBLE"] + [f"({w}::DOUBLE) * {n}" for n, w in COEF.items()])
X = f"""
WITH x AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'Slide ' || CAST(vec_id AS VARCHAR) END AS slide_name, {COLS} FROM embeddings)
, bg AS (SELECT {", ".join(f"avg({n}) AS {n}" for n in FEATURES)} FROM (SELECT * FROM x ORDER BY (id * 7919) % 10007, id LIMIT 100) s)
, phi AS ({" UNION ALL ".join(f"SELECT x.id, '{n}' AS feature, x.{n} AS value, ({w}::DOUBLE) * (x.{n} - bg.{n}) AS phi FROM x, bg" for n, w in COEF.items())})
, rk AS (SELECT CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank, feature, m AS mean_abs, m * 100 / max(m) OVER () AS pct
    FROM (SELECT feature, avg(abs(phi)) AS m FROM phi GROUP BY feature) y)
, probs AS (SELECT *, 1 / (1 + exp(-3 * ({LOGIT}))) AS prob FROM x)
"""


def samples(t):
    logit = F.lit(INTERCEPT)
    cols = [F.get("embedding", i).cast("double").alias(n) for i, n in enumerate(FEATURES)]
    named = F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("Slide "), F.col("vec_id").cast("string")))
    df = t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, 1).otherwise(0).alias("label"),
                             named.alias("slide_name"), *cols)
    for n, w in COEF.items():
        logit = logit + F.lit(w) * F.col(n)
    return df.withColumn("prob", 1 / (1 + F.exp(-3 * logit)))


def means(t):
    order = (F.col("id") * 7919) % 10007
    return attr.background(samples(t), FEATURES, order=order)


def phi(t):
    return attr.linear_attribution(samples(t), COEF, means(t))


@query("l1_background", "", X + "SELECT " + ", ".join(f"round({n}, 9) AS {n}" for n in FEATURES) + " FROM bg")
def l1(t):
    return means(t).withColumns({n: F.round(n, 9) for n in FEATURES})


@query("l2_linear_attribution", "", X + "SELECT id, feature, value, round(phi, 9) AS phi FROM phi")
def l2(t):
    return phi(t).withColumn("phi", F.round("phi", 9))


@query("l2_base_value", "", X + f"SELECT round({LOGIT}, 9) AS base FROM bg")
def l2_base(t):
    return attr.base_value(means(t), COEF, INTERCEPT).withColumn("base", F.round("base", 9))


@query("l3_global_ranking", "", X + "SELECT rank, feature, round(mean_abs, 9) AS mean_abs, round(pct, 6) AS pct_of_top FROM rk")
def l3(t):
    out = attr.global_ranking(phi(t))
    return out.withColumns({"mean_abs": F.round("mean_abs", 9), "pct_of_top": F.round("pct_of_top", 6)})


@query("l4_representative_row", "", X + """
SELECT id, slide_name, round(prob, 9) AS prob FROM probs WHERE label = 1 ORDER BY (slide_name IS NOT NULL AND prob > 0.9) DESC, prob DESC, id LIMIT 1""")
def l4(t):
    return attr.representative_row(samples(t)).select("id", "slide_name", F.round("prob", 9).alias("prob"))


@query("l5_local_top", "", X + """
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank, feature, round(phi, 9) AS phi,
  CASE WHEN phi > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS effect FROM phi QUALIFY rank <= 3""")
def l5(t):
    return attr.local_top(phi(t), 3).select("id", "rank", "feature", F.round("phi", 9).alias("phi"), "effect")


@query("l6_additivity_check", "", X + "SELECT count(*) AS rows, TRUE AS additive FROM x")
def l6(t):
    base = attr.base_value(means(t), COEF, INTERCEPT)
    out = attr.additivity_check(samples(t), phi(t), base, COEF, INTERCEPT)
    return out.select("rows", (F.col("max_gap") < 1e-9).alias("additive"))


SHOWN = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in attr.LABELS.items() if k != "num__aspect") + " ELSE feature END"


@query("l7_feature_labels", "", X + f"SELECT rank, feature, {SHOWN} AS label FROM rk")
def l7(t):
    labels = {k: v for k, v in attr.LABELS.items() if k != "num__aspect"}
    return attr.feature_labels(attr.global_ranking(phi(t)), labels).select("rank", "feature", "label")


@query("l8_explanation_text", "", X + f"""
SELECT '{attr.BEFORE.replace("'", "''")}' || string_agg(lower(feature), ', ' ORDER BY rank) || '{attr.AFTER}' AS explanation FROM rk WHERE rank <= 3""")
def l8(t):
    return attr.explanation_text(attr.global_ranking(phi(t)))


def summary(t):
    """Stored form of the whole attribution result."""
    ranking = attr.global_ranking(phi(t))
    sample = attr.representative_row(samples(t))
    return attr.summary(ranking, sample, attr.local_top(phi(t)), "LogisticRegression", "Attribution is not causal proof.")


def fitted(t):
    """Transformed samples of the fitted linear model, its terms and the background."""
    data = materialize(modeling.samples(t), "samples")
    model = models.fit_logistic(data, **modeling.MODEL)
    terms, intercept = models.linear_terms(model, **modeling.MODEL)
    rows = materialize(models.transformed(data, model, **modeling.MODEL), "transformed")
    return rows, terms, intercept, attr.background(rows, list(terms), key="sl_no")


@query("l2_fitted_attribution")
def l2_fitted(t):
    rows, terms, _, means = fitted(t)
    phi = attr.linear_attribution(rows, terms, means, key="sl_no")
    return phi.select("sl_no", "feature", F.round("value", 6).alias("value"), F.round("phi", 6).alias("phi"))


@query("l6_fitted_additivity", "fx_points fx_cells fx_soil", modeling.SAMPLE + f"""
SELECT count(*) FILTER (WHERE {modeling.ALL_KNOWN}) AS rows, TRUE AS additive FROM sample""")
def l6_fitted(t):
    """Contributions and base value add up to the logit that the model itself computed."""
    rows, terms, intercept, means = fitted(t)
    phi = attr.linear_attribution(rows, terms, means, key="sl_no")
    check = attr.additivity_check(rows, phi, attr.base_value(means, terms, intercept), terms, intercept, key="sl_no", own="logit")
    return check.select("rows", (F.col("max_gap") < 1e-9).alias("additive"))
