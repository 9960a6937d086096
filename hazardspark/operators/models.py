"""Susceptibility models: ridge regression and forests of pyspark.ml, boosting of this package."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hazardspark.functions.numeric import nan_to_null
from hazardspark.operators import boosting, dataset, ensembles, metrics
from hazardspark.operators.boosting import Boosted
from hazardspark.session import materialize, new_path

# fixed values: conditioning factors
NUMERIC = ("elevation", "slope", "aspect", "curvature", "soil_clay_0_5cm", "soil_sand_0_5cm", "soil_silt_0_5cm",
           "soil_bulk_density_0_5cm")
CATEGORICAL = ("land_cover",)
TASK_ROWS = 20_000  # rows worth a task of the iterative fits
PASS_MB = 64  # histograms of a forest that a task fills in one pass; what the driver sends and gets follows them
SIDE_BY_SIDE = 8  # fits, folds and seeds whose jobs run at a time


def prep_stages(n: int, numeric: tuple[str, ...] = NUMERIC, categorical: tuple[str, ...] = CATEGORICAL) -> list[Transformer]:
    """Scale numerics by the population deviation of the ``n`` training rows; one-hot
    categories, all zeros for a category that is missing or not seen in training.

    A missing numeric value becomes NaN; fits leave such rows out, scores are NULL.
    """
    # the scaler divides by the sample deviation
    to_population = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    indexed, hot = [f"{c}_idx" for c in categorical], [f"{c}_hot" for c in categorical]
    return [
        StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=list(numeric), outputCol="_numeric", handleInvalid="keep"),
        StandardScaler(inputCol="_numeric", outputCol="_sample_scaled", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="_sample_scaled", outputCol="_scaled", scalingVec=Vectors.dense([to_population] * len(numeric))),
        VectorAssembler(inputCols=["_scaled", *hot], outputCol="features", handleInvalid="keep"),
    ]


def prep_pipeline(n: int, numeric=NUMERIC, categorical=CATEGORICAL) -> Pipeline:
    return Pipeline(stages=prep_stages(n, numeric, categorical))


def complete(numeric=NUMERIC) -> Column:
    """True where no numeric feature is missing."""
    return reduce(Column.__and__, [nan_to_null(F.col(c).cast("double")).isNotNull() for c in numeric])


def missing_features(df: DataFrame, numeric=NUMERIC) -> DataFrame:
    """Rows, and those which a fit leaves out and a score leaves NULL."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~complete(numeric)).alias("without_score"))


def _training_rows(df: DataFrame, label: str, numeric, categorical, parts: int | None) -> tuple[DataFrame, int]:
    """The rows with all numeric features, cached for the many passes of a fit, and their count.

    Iterative fits run thousands of short stages; ``parts`` sets in how many even partitions the
    rows are kept (by default one for each ``TASK_ROWS`` rows, but no more than there are cores:
    a level of a forest shuffles its histograms once for each partition). Forests draw their
    samples per partition, so a fit repeats for the same partitions only.
    """
    rows = df.where(complete(numeric) & F.col(label).isNotNull()).select(*numeric, *categorical, label)
    n = rows.count()
    if parts is None:
        parts = min(max(1, -(-n // TASK_ROWS)), df.sparkSession.sparkContext.defaultParallelism)
    return (rows.coalesce(1) if parts == 1 else rows.repartition(parts)).persist(), n


def _fit(rows: DataFrame, n: int, classifier, numeric, categorical) -> PipelineModel:
    model = Pipeline(stages=[*prep_stages(n, numeric, categorical), classifier]).fit(rows)
    rows.unpersist()
    return PipelineModel([*model.stages[:-1], _without_summary(model.stages[-1], rows.sparkSession)])


def _without_summary(fitted: Transformer, spark: SparkSession) -> Transformer:
    """The model as stored and loaded again. The training summary of a fresh fit holds the session,
    which cannot go to tasks once some query of the session has been observed."""
    path = new_path(spark, "model")
    fitted.write().save(path)
    return type(fitted).load(path)


def fit_logistic(df: DataFrame, c: float = 1.0, label: str = "label", numeric=NUMERIC, categorical=CATEGORICAL,
                 parts: int | None = None) -> PipelineModel:
    """Ridge logistic regression; ``c`` weighs the data against the penalty."""
    rows, n = _training_rows(df, label, numeric, categorical, parts)
    reg = 1.0 / (c * n)
    clf = LogisticRegression(labelCol=label, regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=1000)
    return _fit(rows, n, clf, numeric, categorical)


def fit_forest(df: DataFrame, trees: int = 200, depth: int = 10, leaf: int = 3, seed: int = 42, label: str = "label",
               numeric=NUMERIC, categorical=CATEGORICAL, parts: int | None = None) -> PipelineModel:
    """Random forest. The node of a row is kept beside it, so no level sends the trees to its tasks."""
    rows, n = _training_rows(df, label, numeric, categorical, parts)
    clf = RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, cacheNodeIds=True,
        maxMemoryInMB=PASS_MB)
    return _fit(rows, n, clf, numeric, categorical)


def _boosting(rounds, rate, depth, subsample, columns, seed) -> boosting.Settings:
    return boosting.Settings(rounds=rounds, rate=rate, depth=depth, subsample=subsample, columns=columns, seed=seed)


def fit_boosted(df: DataFrame, rounds: int = 200, rate: float = 0.05, depth: int = 6, subsample: float = 0.8,
                columns: float = 0.8, seed: int = 42, label: str = "label", numeric=NUMERIC,
                categorical=CATEGORICAL, key: str | None = None) -> Boosted:
    """Second-order boosting (:mod:`hazardspark.operators.boosting`); ``key`` tells rows apart for sampling."""
    settings = _boosting(rounds, rate, depth, subsample, columns, seed)
    return boosting.fit(df, label=label, numeric=numeric, categorical=categorical, key=key, settings=settings)


def fit_boosted_many(df: DataFrame, fits: Column, rounds: int = 200, rate: float = 0.05, depth: int = 6, subsample: float = 0.8,
                     columns: float = 0.8, seed: int = 42, label: str = "label", numeric=NUMERIC,
                     categorical=CATEGORICAL, key: str | None = None) -> dict[int, Boosted]:
    """One boosted model per number in ``fits`` (an array column), grown side by side in the same jobs."""
    settings = _boosting(rounds, rate, depth, subsample, columns, seed)
    return boosting.fit_many(df, fits, label=label, numeric=numeric, categorical=categorical, key=key, settings=settings)


class Fit(NamedTuple):
    """A way to fit: ``one(train, **options)``, and ``many(rows, fits, **options)`` where a model can
    be fitted for all folds or seeds at once."""

    one: Callable
    options: dict = {}
    many: Callable | None = None


def score(df: DataFrame, model: PipelineModel | Boosted, prob: str = "prob") -> DataFrame:
    """Add the probability of class 1; NULL for a row without some numeric feature."""
    if isinstance(model, Boosted):
        return boosting.score(df, model, prob)
    known = complete(next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols())
    scored = model.transform(df).withColumn(prob, F.when(known, vector_to_array("probability")[1]))
    return scored.select(*df.columns, prob)


def feature_names(model: PipelineModel, numeric=NUMERIC, categorical=CATEGORICAL) -> list[str]:
    labels = model.stages[0].labelsArray
    return [*numeric, *[f"{c}_{v}" for c, values in zip(categorical, labels) for v in values]]


def linear_terms(model: PipelineModel, numeric=NUMERIC, categorical=CATEGORICAL) -> tuple[dict[str, float], float]:
    """Coefficients of a fitted linear pipeline by transformed feature, and its intercept.

    Names are ``num__`` or ``cat__`` and the feature, one-hot columns included.
    """
    kinds = ["num__"] * len(numeric)
    names = feature_names(model, numeric, categorical)
    kinds += ["cat__"] * (len(names) - len(numeric))
    last = model.stages[-1]
    return {k + n: float(w) for k, n, w in zip(kinds, names, last.coefficients.toArray())}, float(last.intercept)


def transformed(df: DataFrame, model: PipelineModel, numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    """Scorable rows with one column per transformed feature and the model's own ``logit``."""
    names = list(linear_terms(model, numeric, categorical)[0])
    values = F.col("_values")
    ready = model.transform(df.where(complete(numeric))).select(
        *df.columns, vector_to_array("features").alias("_values"), vector_to_array("rawPrediction")[1].alias("logit"))
    return ready.select(*df.columns, *[values[i].alias(n) for i, n in enumerate(names)], "logit")


def penalised_gradient(df: DataFrame, model: PipelineModel, label: str = "label", numeric=NUMERIC,
                       categorical=CATEGORICAL) -> DataFrame:
    """Gradient of the penalised mean log loss at the fitted coefficients, one row per
    feature and ``intercept``; zero at the optimum of the rows it was fitted on."""
    coefficients, _ = linear_terms(model, numeric, categorical)
    reg = model.stages[-1].getRegParam()
    off = 1 / (1 + F.exp(-F.col("logit"))) - F.col(label)
    rows = transformed(df.where(F.col(label).isNotNull()), model, numeric, categorical)
    means = rows.agg(F.avg(off).alias("intercept"), *[F.avg(off * F.col(c)).alias(c) for c in coefficients])
    entries = [F.struct(F.lit("intercept").alias("feature"), F.col("intercept").alias("gradient"))]
    entries += [F.struct(F.lit(c).alias("feature"), (F.col(c) + F.lit(reg * w)).alias("gradient")) for c, w in coefficients.items()]
    return means.select(F.inline(F.array(*entries)))


def walked_probability(df: DataFrame, model: PipelineModel, prob: str = "walked") -> DataFrame:
    """Add the probability of a fitted forest by walking its node table, beside :func:`score`."""
    nodes, forest = ensembles.forest_nodes(model, df.sparkSession), model.stages[-1]
    known = complete(next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols())
    ready = model.transform(df).select(*df.columns, F.when(known, vector_to_array("features")).alias("_in"))
    walked = ensembles.leaf_values(ready, nodes, F.col("_in"), forest.getMaxDepth(), "_leaves")
    mean = F.aggregate("_leaves", F.lit(0.0), lambda s, v: s + v) / F.lit(float(forest.getNumTrees))
    return walked.withColumn(prob, mean).select(*df.columns, prob)


def feature_ranking(spark: SparkSession, model: PipelineModel | Boosted, numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    """Coefficients or importances by absolute value; one row per model feature."""
    if isinstance(model, Boosted):
        nodes = spark.createDataFrame(model.nodes, ensembles.NODES)
        ranked = ensembles.importances(nodes, model.names, per_tree=False, weighted=False)
        return ranked.orderBy(F.desc("value"), "feature")
    last = model.stages[-1]
    values = (last.coefficients if hasattr(last, "coefficients") else last.featureImportances).toArray()
    rows = [(n, float(v)) for n, v in zip(feature_names(model, numeric, categorical), values)]
    return spark.createDataFrame(rows, "feature string, value double").orderBy(F.desc(F.abs("value")), "feature")


def _at_once(tasks: list[Callable]) -> list:
    """What the tasks return, in their order. Their jobs run side by side, as those of a
    cross-validator with ``parallelism`` do: each alone is too short to fill a cluster."""
    with ThreadPool(min(SIDE_BY_SIDE, len(tasks))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(task) for task in tasks], chunksize=1)


def _evaluated(fits: dict, splits: DataFrame, numbers: list[int], evaluate: Callable, **kw) -> list[DataFrame]:
    """``evaluate(name, number, model)`` for each model on the training rows of each split;
    ``splits`` has them all, by ``_split``. The longest fits start first."""
    train = splits.where(~F.col("is_test"))
    tasks, order = [], []
    for name, fit in fits.items():
        fit = fit if isinstance(fit, Fit) else Fit(fit)
        if fit.many is not None:
            def run(name=name, fit=fit):
                models = fit.many(train, F.array("_split"), **kw, **fit.options)
                return [(name, number, evaluate(name, number, model)) for number, model in models.items()]
            tasks.insert(0, run)
        else:
            for number in numbers:
                def run(name=name, fit=fit, number=number):
                    model = fit.one(train.where(F.col("_split") == number), **kw, **fit.options)
                    return [(name, number, evaluate(name, number, model))]
                tasks.append(run)
        order.append(name)
    found = [part for parts in _at_once(tasks) for part in parts]
    return [df for _, _, df in sorted(found, key=lambda part: (order.index(part[0]), part[1]))]


def _stored_splits(splits: list[Callable[[], DataFrame]]) -> DataFrame:
    """All splits in one table, each made and written once for all models."""
    def stored(i: int, split: Callable[[], DataFrame]):
        return lambda: materialize(split().withColumn("_split", F.lit(i)), "split")

    return reduce(DataFrame.unionByName, _at_once([stored(i, s) for i, s in enumerate(splits)]))


def _buffered(split: DataFrame, key: str, metres: float | None) -> DataFrame:
    return split if metres is None else dataset.buffered_train(split, key, metres)


def seed_stability(df: DataFrame, group: str, key: str, seeds: list[int], fits: dict, metres: float | None = 500.0,
                   **kw) -> DataFrame:
    """ROC-AUC of every model for a fresh hold-out per seed."""
    splits = _stored_splits([
        lambda seed=seed: _buffered(dataset.group_holdout(df, group, seed=seed), key, metres) for seed in seeds])

    def evaluate(name: str, i: int, model) -> DataFrame:
        auc = metrics.roc_auc(score(splits.where((F.col("_split") == i) & F.col("is_test")), model))
        return materialize(auc.select(F.lit(name).alias("model"), F.lit(seeds[i]).alias("seed"), "roc_auc"), "auc")

    return reduce(DataFrame.unionByName, _evaluated(fits, splits, list(range(len(seeds))), evaluate, **kw))


def cross_validate(df: DataFrame, group: str, key: str, fits: dict, k: int = 5, metres: float | None = 500.0,
                   **kw) -> DataFrame:
    """Metrics per model and fold of grouped cross-validation, in long form."""
    folded = materialize(dataset.group_kfold(df, group, k), "folds")
    splits = _stored_splits([
        lambda fold=fold: _buffered(folded.withColumn("is_test", F.col("fold") == fold), key, metres)
        for fold in range(k)])

    def evaluate(name: str, fold: int, model) -> DataFrame:
        scored = score(splits.where((F.col("_split") == fold) & F.col("is_test")), model)
        rows = metrics.report(scored).select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "metric", "value")
        return materialize(rows, "report")

    return reduce(DataFrame.unionByName, _evaluated(fits, splits, list(range(k)), evaluate, **kw))
