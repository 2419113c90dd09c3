"""Balanced sampling and folds by md5 order, the same in any engine and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.operators.ranking import attach_one_row, hash_key, rank_by_hash

FOLD_SEED = 5


def balanced_sample(genes: DataFrame, replicates: int = 50) -> DataFrame:
    """(replicate, gene, class): all positives and as many negatives, drawn without replacement."""
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    negatives = genes.where("class = 0").select(reps, "gene", "class")
    key = hash_key(F.col("gene").cast("string"), F.col("replicate").cast("string"))
    ranked = rank_by_hash(negatives, ["replicate"], key, "gene")
    wanted = genes.agg(F.count_if(F.col("class") == 1).alias("n_pos"))
    drawn = attach_one_row(ranked, wanted).where("rank <= n_pos").select("replicate", "gene", "class")
    return genes.where("class = 1").select(reps, "gene", "class").unionByName(drawn)


def _tile(rank: Column, total: Column, k: int) -> Column:
    """The tile of a rank when ``total`` rows are cut into ``k`` tiles, the larger ones first."""
    small, larger = F.floor(total / k), total % k
    edge = larger * (small + 1)
    return F.when(rank <= edge, F.ceil(rank / (small + 1))).otherwise(larger + F.ceil((rank - edge) / small)).cast("int")


def _folds(rows: DataFrame, by: list[str], key: Column, k: int) -> DataFrame:
    ranked = rank_by_hash(rows, by, key, "gene")
    totals = rows.groupBy(*by).agg(F.count("*").alias("_total"))
    sized = ranked.join(totals, by) if by else attach_one_row(ranked, totals)
    return sized.withColumn("fold", _tile(F.col("rank"), F.col("_total"), k)).drop("rank", "_total")


def kfold(rows: DataFrame, k: int = 10, seed: int = FOLD_SEED, by: list[str] | None = None) -> DataFrame:
    """Shuffled folds 1..k of equal size, per group of ``by``."""
    return _folds(rows, by or [], hash_key(F.col("gene").cast("string"), F.lit(str(seed))), k)


def stratified_kfold(rows: DataFrame, k: int = 10, by: list[str] | None = None, seeded: bool = False) -> DataFrame:
    """Folds that each hold the same share of every class; with ``seeded`` each group of ``by`` has an order of its own."""
    seed = [F.col(c).cast("string") for c in by or []] if seeded else []
    return _folds(rows, [*(by or []), "class"], hash_key(F.col("gene").cast("string"), *seed), k)
