"""Classifier metrics from scored rows; ``class`` and ``predicted`` are 0/1, ``score`` is real."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.operators.ranking import BUCKET, attach_one_row, running, score_bucket


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """TP, TN, FP, FN with precision, recall, F1 and accuracy; null where a denominator is 0."""
    pair = lambda p, c: F.count_if((F.col("predicted") == p) & (F.col("class") == c))
    counts = rows.groupBy(*(by or [])).agg(
        pair(1, 1).alias("tp"), pair(0, 0).alias("tn"), pair(1, 0).alias("fp"), pair(0, 1).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        # 2pr/(p+r), so null when there is no true positive
        "f1": F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)),
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
    })


def accuracy_f1(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy and F1 of the positives; F1 is 0 without a true positive."""
    return confusion(rows, by).select(*(by or []), "accuracy", F.coalesce("f1", F.lit(0.0)).alias("f1"))


def _by_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per distinct score: ties and frequent scores shrink before any window."""
    return rows.groupBy(*by, "score").agg(
        F.count_if(F.col("class") == 1).alias("pos"), F.count_if(F.col("class") == 0).alias("neg"),
    ).withColumn(BUCKET, score_bucket(F.col("score")))


def auc_roc(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sum, ties at half; null when a class is missing."""
    by = by or []
    ranked = running(_by_score(rows, by), by, ["score"], "sum", "neg", "below")
    wins = F.sum(F.col("pos") * (F.col("below") - 0.5 * F.col("neg")))
    return ranked.groupBy(*by).agg(_ratio(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def pr_points(rows: DataFrame) -> DataFrame:
    """(score, tp, fp, precision, recall): one row per threshold, predicted = score ≥ threshold."""
    scores = _by_score(rows, [])
    tp = running(scores, [], ["score"], "sum", "pos", "tp", descending=True)
    both = running(tp, [], ["score"], "sum", "neg", "fp", descending=True)
    total = rows.agg(F.count_if(F.col("class") == 1).alias("n_pos"))
    return attach_one_row(both, total).select(
        "score", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _ratio(F.col("tp"), F.col("n_pos")).alias("recall"))


def average_scores(results: DataFrame, params: list[str]) -> DataFrame:
    """Mean score per parameter setting, best first."""
    return results.groupBy(*params).agg(F.avg("score").alias("score")).orderBy(F.desc("score"), *params)
