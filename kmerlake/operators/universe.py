"""The set of all words of one length, their strand classes and their unordered pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kmerlake.functions.words import canonical, strand_token, word_from_index

_RANK_BLOCK = 4096


def kmer_universe(spark: SparkSession, k: int) -> DataFrame:
    """(idx, word): all 4^k words in universe order."""
    return spark.range(4**k).select(F.col("id").alias("idx"), word_from_index(F.col("id"), k).alias("word"))


def canonical_size(k: int) -> int:
    return (4**k + (4 ** (k // 2) if k % 2 == 0 else 0)) // 2


def canonical_words(spark: SparkSession, k: int) -> DataFrame:
    """(idx, word, token): one word per strand class, ``token`` is ``K.RC``; palindromes stay."""
    kept = kmer_universe(spark, k).where(canonical(F.col("word")) == F.col("word"))
    return kept.withColumn("token", strand_token(F.col("word")))


def canonical_kmers(spark: SparkSession, k: int) -> DataFrame:
    """(rank, word, token): the strand classes numbered in universe order."""
    kept = canonical_words(spark, k).withColumn("block", F.col("idx").bitwiseAND(F.lit(-_RANK_BLOCK)))
    sizes = kept.groupBy("block").agg(F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("block").orderBy("idx")
    return kept.join(offsets, "block").select(
        (F.col("offset") + F.row_number().over(inside) - 1).alias("rank"), "word", "token")


def _pair_indices(spark: SparkSession, n: int) -> DataFrame:
    """All (i, j), i < j < n, decoded from a range: no join is needed to list pairs."""
    def first(i: Column) -> Column:  # number of pairs before row i
        return F.expr("0").cast("long") + i * (F.lit(2 * n - 1) - i) / 2

    pair = F.col("id")
    guess = F.floor((F.lit(2.0 * n - 1) - F.sqrt(F.lit(float(2 * n - 1) ** 2) - 8.0 * pair)) / 2)
    row = spark.range(n * (n - 1) // 2).withColumn("i", guess)
    row = row.withColumn("i", F.col("i") - F.when(first(F.col("i")) > pair, 1).otherwise(0))
    row = row.withColumn("i", F.col("i") + F.when(first(F.col("i") + 1) <= pair, 1).otherwise(0))
    return row.select("i", (pair - first(F.col("i")).cast("long") + F.col("i") + 1).alias("j"))


def kmer_pairs(spark: SparkSession, k: int) -> DataFrame:
    """(i, j, first, second, token): every unordered pair of distinct words, ``A B`` in universe order."""
    pairs = _pair_indices(spark, 4**k).select(
        F.col("i").cast("long"), F.col("j").cast("long"), word_from_index(F.col("i"), k).alias("first"), word_from_index(F.col("j"), k).alias("second"))
    return pairs.withColumn("token", F.concat_ws(" ", "first", "second"))


def canonical_pairs(spark: SparkSession, k: int) -> DataFrame:
    """(i, j, first, second, token): every unordered pair of strand tokens, ``A.RA B.RB``, with their ranks."""
    units = canonical_kmers(spark, k)
    pairs = _pair_indices(spark, canonical_size(k))
    return (
        pairs.join(units.select(F.col("rank").alias("i"), F.col("token").alias("first")), "i")
        .join(units.select(F.col("rank").alias("j"), F.col("token").alias("second")), "j")
        .select(F.col("i").cast("long"), F.col("j").cast("long"), "first", "second", F.concat_ws(" ", "first", "second").alias("token"))
    )
