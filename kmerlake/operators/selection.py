"""Feature selection and importance ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.operators.enrichment import class_counts, class_sizes
from kmerlake.operators.ranking import BUCKET, attach_one_row, running, score_bucket


def chi2_scores(presence: DataFrame, genes: DataFrame) -> DataFrame:
    """(feature, chi2): feature sums per class against class prior × feature total."""
    rows = attach_one_row(class_counts(presence), class_sizes(genes))
    total = F.col("pos_count") + F.col("neg_count")
    n = F.col("n_pos") + F.col("n_neg")
    part = lambda seen, size: F.pow(seen - total * size / n, F.lit(2.0)) / (total * size / n)
    score = part(F.col("pos_count"), F.col("n_pos")) + part(F.col("neg_count"), F.col("n_neg"))
    return rows.select(F.col("token").alias("feature"), score.alias("chi2"))


def chi2_select(presence: DataFrame, genes: DataFrame, n: int) -> DataFrame:
    """The ``n`` best features; sorted and cut per task before the final merge."""
    return chi2_scores(presence, genes).orderBy(F.desc("chi2"), "feature").limit(n)


def rank_importance(importance: DataFrame) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature")


def top_n(importance: DataFrame, n: int) -> DataFrame:
    return rank_importance(importance).limit(n)


def with_rank(importance: DataFrame) -> DataFrame:
    """Add ``rank`` (1 = most important) and ``n_features`` without a one-task sort."""
    rows = importance.withColumn("_neg", -F.col("importance")).withColumn(BUCKET, score_bucket(F.col("_neg")))
    ranked = running(rows.withColumn("_one", F.lit(1)), [], ["_neg", "feature"], "sum", "_one", "rank")
    return attach_one_row(ranked.drop("_neg", "_one", BUCKET), importance.agg(F.count("*").alias("n_features")))


def top_percent(importance: DataFrame, percent: float) -> DataFrame:
    """The first floor(count · percent / 100) features."""
    return with_rank(importance).where(F.col("rank") <= F.floor(F.col("n_features") * percent / 100)).select(
        "feature", "importance")


def importance_cutoff(importance: DataFrame, cutoff: float) -> DataFrame:
    return importance.where(F.col("importance") >= cutoff)


def mean_importance(replicates: DataFrame) -> DataFrame:
    return replicates.groupBy("feature").agg(F.avg("importance").alias("importance"))


def project_selected(presence: DataFrame, selected: DataFrame) -> DataFrame:
    """Presence rows of the selected features."""
    return presence.join(selected.select(F.col("feature").alias("token")), "token", "left_semi").select(*presence.columns)
