"""Class counts, exact tests and false-discovery control."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.functions import exact
from kmerlake.operators.presence import pair_kinds, presence_matrix, presence_pair_stranded, presence_stranded
from kmerlake.operators.ranking import BUCKET, attach_one_row, log_probability_bucket, running
from kmerlake.session import materialise


def class_counts(presence: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(token, pos_count, neg_count); listed tokens that no gene holds keep zeros."""
    counts = presence.groupBy("token").agg(
        F.count_if(F.col("class") == 1).alias("pos_count"), F.count_if(F.col("class") == 0).alias("neg_count"))
    if tokens is None:
        return counts
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return tokens.select("token").distinct().join(counts, "token", "left").select(
        "token", zero("pos_count"), zero("neg_count"))


def class_sizes(seqs: DataFrame) -> DataFrame:
    """One row: n_pos, n_neg."""
    return seqs.agg(
        F.count_if(F.col("class") == 1).alias("n_pos"), F.count_if(F.col("class") == 0).alias("n_neg"))


def fisher_greater(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add n_pos, n_neg, the one-sided p-value and its natural logarithm ``ln_p``."""
    ln_p = exact.ln_fisher_greater(F.col("pos_count"), F.col("n_pos"), F.col("neg_count"), F.col("n_neg"))
    return _with_p(attach_one_row(counts, sizes), ln_p)


def _with_p(df: DataFrame, ln_p: Column) -> DataFrame:
    return df.withColumn("ln_p", ln_p).withColumn("pvalue", F.exp("ln_p"))


def fisher_balanced(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """One-sided p-value with both classes taken as half of the data rows (floored)."""
    rows = F.col("n_pos") + F.col("n_neg")
    return _with_p(attach_one_row(counts, sizes), exact.ln_fisher_balanced(F.col("pos_count"), F.col("neg_count"), rows))


def fisher_two_sided(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add the odds ratio and the two-sided p-value."""
    cells = [F.col(c) for c in ("pos_count", "n_pos", "neg_count", "n_neg")]
    return _with_p(
        attach_one_row(counts, sizes).withColumn("odds", exact.odds_ratio(*cells)), exact.ln_fisher_two_sided(*cells))


def filter_enriched(results: DataFrame, cutoff: float = 0.01, by: str = "pvalue") -> DataFrame:
    return results.where(F.col(by) <= cutoff)


def natural_log(p: Column) -> Column:
    return F.when(p == 0, F.lit(float("-inf"))).otherwise(F.log(p))


def bh_adjust(results: DataFrame, by: list[str] | None = None, p: str = "pvalue", out: str = "padj") -> DataFrame:
    """Benjamini–Hochberg inside each family; adds ``padj`` and its logarithm ``ln_padj``.

    Works on ``ln_p`` if the results have it, so that p-values too small for a double still rank.
    Rows without a p-value stay, without an adjusted one, and do not count in the family.
    Works on distinct p-values with their counts: tied tokens (often a third of a family at
    p = 1) shrink to one row, and p-values are ranked over buckets. The results are used for
    ranks, sizes and the output, so they are written to the shared folder once.
    """
    by = by or []
    has_log = "ln_p" in results.columns
    results = materialise(results.withColumn("_ln", F.col("ln_p") if has_log else natural_log(F.col(p))))
    known = results.where("_ln is not null")
    groups = known.groupBy(*by, "_ln").agg(F.count("*").alias("_n")).withColumn(BUCKET, log_probability_bucket(F.col("_ln")))
    sizes = known.groupBy(*by).agg(F.count("*").alias("_size"))
    ranked = running(groups, by, ["_ln"], "sum", "_n", "_rank")
    ranked = ranked.join(sizes, by) if by else attach_one_row(ranked, sizes)
    ranked = ranked.withColumn("_raw", F.col("_ln") + F.log(F.col("_size") / F.col("_rank")))
    adjusted = running(ranked, by, ["_ln"], "min", "_raw", "_least", descending=True).select(
        *by, "_ln", F.least(F.lit(0.0), "_least").alias(f"ln_{out}"))
    return results.join(adjusted, [*by, "_ln"], "left").drop("_ln").withColumn(out, F.exp(f"ln_{out}"))


def stranded_presence(seqs: DataFrame, tokens: DataFrame, lengths: Iterable[int] | None = None) -> DataFrame:
    """Presence as the growth search tests it: both strands for single words and for pair members."""
    pair = F.col("token").contains(" ")
    any_pairs, only_pairs = pair_kinds(tokens)
    if not any_pairs:
        return presence_stranded(seqs, tokens, lengths)
    if only_pairs:
        return presence_pair_stranded(seqs, tokens, lengths)
    return presence_stranded(seqs, tokens.where(~pair), lengths).unionByName(
        presence_pair_stranded(seqs, tokens.where(pair), lengths))


def tested_tokens(
    presence: DataFrame, tokens: DataFrame, sizes: DataFrame, fdr: bool = False
) -> DataFrame:
    """Counts → one-sided test → optional adjustment, one row per token."""
    results = fisher_greater(class_counts(presence, tokens), sizes)
    return bh_adjust(results) if fdr else unadjusted(results)


def unadjusted(results: DataFrame) -> DataFrame:
    return results.withColumns({"padj": F.col("pvalue"), "ln_padj": F.col("ln_p")})


def enrich(
    seqs: DataFrame, tokens: DataFrame, cutoff: float = 0.01, fdr: bool = False,
    lengths: Iterable[int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Enriched tokens and their presence rows; the small result table is written once."""
    presence = presence_matrix(seqs, tokens, lengths)
    results = tested_tokens(presence, tokens, class_sizes(seqs), fdr)
    kept = materialise(filter_enriched(results, cutoff, "padj"))
    return kept, presence.join(kept.select("token"), "token", "left_semi")


def mean_sd_se(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population standard deviation and standard error."""
    sd = F.stddev_pop(value)
    return df.groupBy(*(by or [])).agg(
        F.avg(value).alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count(value))).alias("se"))


# Fixed value: the normal quantile at 0.975.
Z_975 = 1.959963984540054


def mean_sd_se_ci(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, sample standard deviation, standard error and the normal 95% interval."""
    mean, sd = F.avg(value), F.stddev_samp(value)
    se = sd / F.sqrt(F.count(value))
    return df.groupBy(*(by or [])).agg(
        mean.alias("mean"), sd.alias("sd"), se.alias("se"),
        (mean - Z_975 * se).alias("ci_lower"), (mean + Z_975 * se).alias("ci_upper"))
