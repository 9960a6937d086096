"""Classifier metrics from ``label`` (0/1) and ``prob``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardspark.functions.numeric import ratio, rounded
from hazardspark.operators.ordering import running_totals

# fixed values: sweep from .10 to .90 by .05
THRESHOLDS = tuple(round(0.10 + 0.05 * i, 2) for i in range(17))


def _cells(t: float) -> dict[str, Column]:
    hit, pos = F.col("prob") >= F.lit(t), F.col("label") == 1
    return {"tp": F.count_if(hit & pos), "fp": F.count_if(hit & ~pos), "fn": F.count_if(~hit & pos), "tn": F.count_if(~hit & ~pos)}


def _or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def _scores() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": _or_zero(tp + tn, tp + fp + fn + tn),
        "precision": _or_zero(tp, tp + fp),
        "recall": _or_zero(tp, tp + fn),
        "f1": _or_zero(2 * tp, 2 * tp + fp + fn),
    }


def confusion(df: DataFrame, t: float = 0.5) -> DataFrame:
    """TP, FP, FN, TN and the derived scores; a zero denominator gives 0."""
    return df.agg(*[v.alias(k) for k, v in _cells(t).items()]).withColumns(_scores())


def threshold_sweep(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Confusion at every threshold from one aggregate over the rows."""
    rows = F.array(*[
        F.struct(F.lit(t).alias("threshold"), *[v.alias(k) for k, v in _cells(t).items()]) for t in thresholds])
    return df.agg(rows.alias("_r")).select(F.inline("_r")).withColumns(_scores())


def threshold_lookup(sweep: DataFrame, t: float = 0.35) -> DataFrame:
    return sweep.where(F.abs(F.col("threshold") - F.lit(t)) < 1e-9)


def best_threshold(sweep: DataFrame, by: str = "f1") -> DataFrame:
    return sweep.orderBy(F.desc(by), "threshold").limit(1)


def score_curve(df: DataFrame) -> DataFrame:
    """Per distinct score, highest first: positives, negatives and running totals.

    Scores may be as many as rows, so the totals run over ranges, not in one task.
    """
    per_score = df.groupBy("prob").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    return running_totals(per_score, [F.desc("prob")], {"tp": F.col("pos"), "fp": F.col("neg")})


def _auc() -> Column:
    pos, neg = F.sum(F.col("pos").cast("double")), F.sum(F.col("neg").cast("double"))
    # negatives still to come below this score, plus half of those on it
    right = F.sum(F.col("pos") * (F.lit(-1) * F.col("fp") + F.col("neg") / 2))
    return ratio(right + pos * neg, pos * neg)


def _average_precision() -> Column:
    step = F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return ratio(F.sum(step), F.sum("pos"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties count half."""
    return score_curve(df).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame) -> DataFrame:
    return score_curve(df).agg(_average_precision().alias("average_precision"))


def brier(df: DataFrame) -> DataFrame:
    gap = F.col("prob") - F.col("label")
    return df.agg(F.avg(gap * gap).alias("brier"))


def report(df: DataFrame, t: float = 0.5) -> DataFrame:
    """The metrics of one model in long form.

    All of them follow from one score curve, so the scored rows are read once.
    """
    prob, pos, neg = F.col("prob"), F.col("pos"), F.col("neg")
    hit = prob >= F.lit(t)

    def n(side: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, side)), F.lit(0))

    gaps = F.sum(pos * (1 - prob) * (1 - prob) + neg * prob * prob)
    one = score_curve(df).agg(
        _auc().alias("roc_auc"), _average_precision().alias("average_precision"),
        ratio(gaps, F.sum(F.when(prob.isNotNull(), pos + neg))).alias("brier"),
        n(pos, hit).alias("tp"), n(neg, hit).alias("fp"), n(pos, ~hit).alias("fn"), n(neg, ~hit).alias("tn"),
    ).withColumns(_scores())
    rows = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns]
    return one.select(F.inline(F.array(*rows)))


def calibration(df: DataFrame, bins: int = 8) -> DataFrame:
    """Mean probability and observed share per non-empty right-closed bin."""
    index = F.greatest(F.ceil(F.col("prob") * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("prob").alias("prob_pred"), F.avg(F.col("label").cast("double")).alias("prob_true"))


def with_outcome(df: DataFrame, t: float = 0.35) -> DataFrame:
    hit, pos = F.col("prob") >= F.lit(t), F.col("label") == 1
    return df.withColumn("outcome", F.when(hit & pos, "TP").when(hit, "FP").when(pos, "FN").otherwise("TN"))


def error_analysis(df: DataFrame, cols: list[str], t: float = 0.35) -> DataFrame:
    """Rows per outcome with mean, min and max of the given columns."""
    stats = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return with_outcome(df, t).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), *stats)


def error_classes(df: DataFrame, col: str, t: float = 0.35) -> DataFrame:
    """Class counts of the wrong predictions."""
    wrong = with_outcome(df, t).where(F.col("outcome").isin("FN", "FP"))
    return wrong.groupBy("outcome", col).agg(F.count(F.lit(1)).alias("n"))


def cv_summary(scores: DataFrame, digits: int | None = 4) -> DataFrame:
    """Mean and population std per model and metric."""
    return scores.groupBy("model", "metric").agg(
        rounded(F.avg("value"), digits).alias("mean"), rounded(F.stddev_pop("value"), digits).alias("std"))


def select_best(metrics: DataFrame, by: str = "roc_auc", order: str = "position") -> DataFrame:
    """Highest value; the earlier model wins a tie."""
    return metrics.orderBy(F.desc(by), order).limit(1)


