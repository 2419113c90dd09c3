"""Which sequence holds which token, kept as a long table of ones (gene, class, token).

``word in text`` equals membership in the windows of the same length, so presence is an
equi-join of windows with the words of the tokens. No join is forced to broadcast: small
token lists are broadcast by their measured size, larger ones are shuffled by word.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.functions.words import reverse_complement
from kmerlake.operators.bitmaps import KEYS, held_units, open_terms, pair_counts
from kmerlake.operators.gene_words import gene_words
from kmerlake.operators.places import strand_class
from kmerlake.operators.universe import canonical_kmers, canonical_pairs, canonical_size, kmer_pairs, kmer_universe


def _lengths(words: DataFrame, lengths: Iterable[int] | None) -> list[int]:
    """Lengths of the words: one row for each, read from the words unless the caller states them.

    A stated list is the caller's word for it that no token has another length.
    """
    if lengths is not None:
        return sorted(set(lengths))
    return sorted(r[0] for r in words.select(F.length("word")).distinct().collect())


def _forward(part: Column) -> Column:
    return F.element_at(F.split(part, r"\."), 1)


def _both_strands(part: Column) -> Column:
    """Words of ``K.RC``, or of ``K`` with its reverse complement."""
    stated = F.element_at(F.split(F.concat(part, F.lit(".")), r"\."), 2)
    other = F.when(stated == "", reverse_complement(_forward(part))).otherwise(stated)
    return F.array_distinct(F.array(_forward(part), other))


def _presence(seqs: DataFrame, words: DataFrame, lengths: Iterable[int] | None) -> DataFrame:
    """(gene, class, token) for ``words`` (token, word): present when any of its words is."""
    found = gene_words(seqs, _lengths(words, lengths) or [1])
    return found.join(words, "word").select(*KEYS, "token").distinct()


def presence_single(seqs: DataFrame, kmers: DataFrame, lengths: Iterable[int] | None = None) -> DataFrame:
    """Forward strand only; ``kmers`` has a ``token`` column."""
    words = kmers.select("token", F.col("token").alias("word")).distinct()
    found = gene_words(seqs, _lengths(words, lengths) or [1])
    return found.join(words, "word").select(*KEYS, "token")  # a token has one word, so its genes are distinct


def presence_stranded(seqs: DataFrame, kmers: DataFrame, lengths: Iterable[int] | None = None) -> DataFrame:
    """Forward word or reverse complement; a token that states another word for ``RC`` counts with that."""
    stated = F.element_at(F.split(F.concat("token", F.lit(".")), r"\."), 2)
    if kmers.where((stated != "") & (stated != reverse_complement(_forward(F.col("token"))))).isEmpty():
        words = kmers.select("token", strand_class(_forward(F.col("token"))).alias("word")).distinct()
        found = gene_words(seqs, _lengths(words, lengths) or [1], both=True)
        return found.join(words, "word").select(*KEYS, "token")  # a token has one strand class, so its genes are distinct
    words = kmers.select("token", F.explode(_both_strands(F.col("token"))).alias("word"))
    return _presence(seqs, words, lengths)


def _members(pairs: DataFrame) -> DataFrame:
    parts = F.split("token", " ")
    return pairs.select(
        "token", F.element_at(parts, 1).alias("first"), F.element_at(parts, 2).alias("second"))


def _word_lengths(words: DataFrame, lengths: Iterable[int] | None) -> list[int]:
    return _lengths(words, lengths) or [1]


def _opened(seqs: DataFrame, words: DataFrame, terms: DataFrame, lengths: Iterable[int] | None) -> DataFrame:
    """Genes where the tokens' terms hold (``terms`` as in ``open_terms``); ``words`` maps words to units."""
    words = words.distinct()
    return open_terms(held_units(seqs, words, _word_lengths(words, lengths)), terms)


def _both_terms(members: DataFrame) -> DataFrame:
    units = F.array_distinct(F.array("first", "second"))
    return members.select("token", F.lit(0).alias("term"), F.explode(units).alias("unit")).distinct()


def _unit_tokens(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("first", "second")).alias("token")).distinct()


def presence_pair(seqs: DataFrame, pairs: DataFrame, lengths: Iterable[int] | None = None) -> DataFrame:
    """Both members present on the forward strand; ``pairs`` has tokens ``A B``."""
    members = _members(pairs)
    words = _unit_tokens(members).select(F.col("token").alias("word"), F.col("token").alias("unit"))
    return _opened(seqs, words, _both_terms(members), lengths)


def presence_pair_stranded(
    seqs: DataFrame, pairs: DataFrame, lengths: Iterable[int] | None = None, precedence: str = "strict"
) -> DataFrame:
    """Both members present, each on either strand.

    ``precedence='literal'`` reads the unbracketed test as ``F1 or (R1 and F2) or R2``.
    """
    members = _members(pairs)
    if precedence == "strict":
        words = _unit_tokens(members).select(F.explode(_both_strands(F.col("token"))).alias("word"), F.col("token").alias("unit"))
        return _opened(seqs, words, _both_terms(members), lengths)
    second = _both_strands(F.col("second"))
    terms = F.array(
        F.array(_forward(F.col("first"))),
        F.array_distinct(F.array(F.element_at(_both_strands(F.col("first")), -1), _forward(F.col("second")))),
        F.array(F.element_at(second, -1)))
    listed = members.select("token", F.posexplode(terms).alias("term", "units"))
    terms = listed.select("token", "term", F.explode("units").alias("unit")).distinct()
    return _opened(seqs, terms.select(F.col("unit").alias("word"), "unit"), terms, lengths)


def pair_class_counts(seqs: DataFrame, k: int, stranded: bool = True) -> DataFrame:
    """(token, pos_count, neg_count) of every pair of k-mers (strand classes with ``stranded``), pairs no gene holds with zeros."""
    spark = seqs.sparkSession
    if stranded:
        units = canonical_kmers(spark, k)
        words = units.select(F.explode(_both_strands(F.col("token"))).alias("word"), F.col("rank").cast("long").alias("unit")).distinct()
        pairs, n = canonical_pairs(spark, k), canonical_size(k)
    else:
        words = kmer_universe(spark, k).select("word", F.col("idx").alias("unit"))
        pairs, n = kmer_pairs(spark, k), 4**k
    counts = pair_counts(held_units(seqs, words, [k]), n)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pairs.join(counts, ["i", "j"], "left").select("token", zero("pos_count"), zero("neg_count"))


def pair_kinds(tokens: DataFrame) -> tuple[bool, bool]:
    """(any pairs, only pairs) in a token list."""
    pair = F.col("token").contains(" ")
    kinds = tokens.agg(F.max(pair).alias("any"), F.min(pair).alias("all")).first()
    return bool(kinds["any"]), bool(kinds["all"])


def presence_matrix(seqs: DataFrame, tokens: DataFrame, lengths: Iterable[int] | None = None) -> DataFrame:
    """All token shapes at once: ``K`` forward, ``K.RC`` stranded, ``A B`` and ``A.RA B.RB`` pairs."""
    pair, strand = F.col("token").contains(" "), F.col("token").contains(".")
    any_pairs, _ = pair_kinds(tokens)
    units = tokens.select(F.explode(F.split("token", " ")).alias("token")).distinct()
    words = units.select("token", F.explode(
        F.when(strand, _both_strands(F.col("token"))).otherwise(F.array("token"))).alias("word"))
    if not any_pairs:
        return _presence(seqs, words, lengths)
    single = tokens.where(~pair).select("token", F.lit(0).alias("term"), F.col("token").alias("unit")).distinct()
    terms = _both_terms(_members(tokens.where(pair))).unionByName(single)
    return _opened(seqs, words.withColumnRenamed("token", "unit"), terms, lengths)


def with_structure(matrix: DataFrame, structure: DataFrame) -> DataFrame:
    """Append the structural columns ds1..ds5 of each gene."""
    return matrix.join(structure, "gene", "left")


def feature_subset(presence: DataFrame, features: DataFrame) -> DataFrame:
    """Keep the listed tokens."""
    return presence.join(features.select("token"), "token", "left_semi")


def recode_class(df: DataFrame, positive: str, negative: str, column: str = "class") -> DataFrame:
    """Labels to 1/0; rows with another label leave."""
    label = F.when(F.col(column) == positive, 1).when(F.col(column) == negative, 0)
    return df.withColumn(column, label).where(F.col(column).isNotNull())


def label_class(df: DataFrame, positive: str, negative: str, column: str = "class") -> DataFrame:
    """1/0 to labels, for hand-off files."""
    return df.withColumn(column, F.when(F.col(column) == 1, positive).when(F.col(column) == 0, negative))


def feature_vectors(presence: DataFrame, genes: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(gene, class, features): sparse 0/1 vectors in the order of ``vocabulary``.

    The collected set of a gene is bounded by the vocabulary; genes without a token get zeros.
    """
    from pyspark.ml.feature import CountVectorizerModel

    held = presence.groupBy("gene").agg(F.collect_set("token").alias("tokens"))
    rows = genes.select(*KEYS).join(held, "gene", "left").withColumn(
        "tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="tokens", outputCol="features")
    return model.setBinary(True).transform(rows).drop("tokens")
