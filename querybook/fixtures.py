"""Views that turn the driver tables into sequences, motifs and evidence, in Spark and in SQL.

Whole tables and whole texts are used: every document gives a sequence, every embedding a motif.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.functions.words import canonical, strand_token
from kmerlake.operators.universe import kmer_universe
from kmerlake.operators.windows import sequence_kmers
from kmerlake.sources.motif_text import LETTERS

# The letters of the text and the base each one stands for.
AZ = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
WIDTH = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, "[^a-zA-Z]+", ""), AZ + AZ.upper(), BASES * 2)


POSITIVE = "de"


def _class() -> Column:
    return F.when(F.col("lang") == POSITIVE, 1).otherwise(0).alias("class")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, class, seq) of all documents; the positives are the documents in one language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("gene"), _class(), dna(F.col("text")).alias("seq"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gene"), _class())


def r6(column: Column) -> Column:
    return F.round(column, 6)


def hits(spark: SparkSession, sf_dir: str, k: int, seqs: DataFrame | None = None) -> DataFrame:
    """Hit table of all strand classes: every window of every document (or of ``seqs``), ``kmer`` is ``K.RC``."""
    words = kmer_universe(spark, k).select(
        "word", strand_token(F.col("word")).alias("kmer"),
        F.when(canonical(F.col("word")) == F.col("word"), "+").otherwise("-").alias("dir"))
    opened = sequence_kmers(sequences(spark, sf_dir) if seqs is None else seqs, k).join(words, "word")
    return opened.select("gene", "class", "kmer", "start", (F.col("start") + k - 1).alias("end"), "dir")


def annotate(hit_table: DataFrame, m: int) -> DataFrame:
    """Hits against a made annotation: a peak lies where start + gene is a multiple of ``m``."""
    peak = (F.col("start") + F.col("gene")) % m == 0
    return hit_table.withColumn("details", F.when(peak, "overlap=peak").otherwise("overlap=NA"))


def diversity_text(hit_table: DataFrame) -> DataFrame:
    """(Region, NtDiversity) as the diversity file holds them."""
    region = F.concat(
        F.lit("chr1_"), F.col("start"), F.lit("_"), F.col("end"), F.lit("_"), F.col("gene"),
        F.lit("|promoter|"), F.col("kmer"))
    # Texts of all remainders, made once: the text of a number takes longer than all else in a row.
    texts = F.array(*[(F.lit(rest) / 997.0).cast("string") for rest in range(-99, 100)])
    value = F.element_at(texts, ((F.col("start") * 31 + F.col("gene")) % 100 + 100).cast("int"))
    return hit_table.select(
        region.alias("Region"), F.when(F.col("start") % 7 == 0, "NoDiffSites").otherwise(value).alias("NtDiversity"))


def motif_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability cells of all embeddings: 16 positions of 4 letters, softmax per position."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("motif_id"), F.concat(F.lit("m"), F.col("vec_id")).alias("name"),
        F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("e"))
    cells = rows.select("motif_id", "name", "e", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("pos"))
    # Embedding order of the letters is A, C, T, G.
    at = lambda n: F.element_at("e", F.col("pos") * 4 + n)
    total = at(1) + at(2) + at(3) + at(4)
    order = {"a": 1, "c": 2, "t": 3, "g": 4}
    return cells.select("motif_id", "name", "pos", *[(at(order[x]) / total).alias(x) for x in LETTERS])


# -- the same views in SQL ----------------------------------------------------------------

SEQ = f"""genes AS (SELECT doc_id AS gene, CASE WHEN lang = '{POSITIVE}' THEN 1 ELSE 0 END AS class FROM documents),
sequences AS (
  SELECT doc_id AS gene, CASE WHEN lang = '{POSITIVE}' THEN 1 ELSE 0 END AS class,
         translate(lower(regexp_replace(text, '[^a-zA-Z]', '', 'g')), '{AZ}', '{BASES}') AS seq FROM documents),
sizes AS (SELECT count(*) FILTER (class = 1) AS n_pos, count(*) FILTER (class = 0) AS n_neg FROM genes)"""


def rc_sql(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def order_sql(x: str) -> str:
    return f"translate({x}, 'ATGC', '0123')"


def canon_sql(x: str) -> str:
    return f"CASE WHEN {order_sql(x)} <= {order_sql(rc_sql(x))} THEN {x} ELSE {rc_sql(x)} END"


def token_sql(x: str) -> str:
    return f"(({canon_sql(x)}) || '.' || {rc_sql('(' + canon_sql(x) + ')')})"


def windows_sql(k: int, source: str = "sequences", name: str = "wins") -> str:
    return f"""{name} AS (
  SELECT gene, class, start, substr(seq, start, {k}) AS word FROM (
    SELECT gene, class, seq, unnest(generate_series(1, length(seq) - {k - 1})) AS start
    FROM {source} WHERE length(seq) >= {k}))"""


def universe_sql(k: int, name: str = "universe") -> str:
    letters = " || ".join(
        f"substr('ATGC', CAST((idx // {4 ** p}) % 4 AS INTEGER) + 1, 1)" for p in reversed(range(k)))
    return f"{name} AS (SELECT idx, {letters} AS word FROM range({4 ** k}) t(idx))"


def stranded_sql(k: int, source: str = "sequences", name: str = "stranded") -> str:
    """Distinct (gene, class, token) of strand classes."""
    return f"{windows_sql(k, source)},\n{name} AS (SELECT DISTINCT gene, class, {token_sql('word')} AS token FROM (SELECT DISTINCT gene, class, word FROM wins))"


def counts_sql(presence: str = "stranded", name: str = "counts") -> str:
    return f"""{name} AS (SELECT token, count(*) FILTER (class = 1) AS pos_count, count(*) FILTER (class = 0) AS neg_count
  FROM {presence} GROUP BY token)"""


def _lnc(n: str, k: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - ({k}) + 1.0))"


def ln_pmf_sql(x: str, a: str, m: str, b: str, n: str) -> str:
    """ln of the probability of a table, without the part that all tables share."""
    return f"({_lnc(m, x)} + {_lnc(n, f'({a} + {b} - {x})')})"


def ln_fisher_sql(a: str, m: str, b: str, n: str) -> str:
    """ln of the one-sided p: the terms of all tables at least as extreme, taken against the observed one."""
    own = ln_pmf_sql(a, a, m, b, n)
    term = f"exp({ln_pmf_sql('x', a, m, b, n)} - {own})"
    rest = f"ln(list_sum(list_transform(generate_series({a}, least({m}, {a} + {b})), lambda x: {term})))"
    return f"least(0.0::DOUBLE, {own} - {_lnc(f'({m} + {n})', f'({a} + {b})')} + {rest})"


def fisher_sql(a: str, m: str, b: str, n: str) -> str:
    return f"exp({ln_fisher_sql(a, m, b, n)})"


def ln_fisher_two_sql(a: str, m: str, b: str, n: str) -> str:
    own = ln_pmf_sql(a, a, m, b, n)
    series = f"generate_series(greatest(0, {a} + {b} - {n}), least({m}, {a} + {b}))"
    terms = f"list_filter(list_transform({series}, lambda x: {ln_pmf_sql('x', a, m, b, n)} - {own}), lambda v: v <= ln(1.0000001::DOUBLE))"
    rest = f"ln(list_sum(list_transform({terms}, lambda v: exp(v))))"
    return f"""CASE WHEN {m} = 0 OR {n} = 0 OR {a} + {b} = 0 OR {a} + {b} = {m} + {n} THEN 0.0::DOUBLE ELSE
  least(0.0::DOUBLE, {own} - {_lnc(f'({m} + {n})', f'({a} + {b})')} + {rest}) END"""


def fisher_two_sql(a: str, m: str, b: str, n: str) -> str:
    return f"exp({ln_fisher_two_sql(a, m, b, n)})"


def log_p(ln: str = "ln_p", out: str = "log_p") -> Column:
    """−log10 of a p-value given by its natural logarithm."""
    return F.round((0.0 - F.col(ln)) / math.log(10), 4).alias(out)


def log_p_sql(ln: str = "ln_p", out: str = "log_p") -> str:
    return f"round((0.0::DOUBLE - {ln}) / ln(10.0::DOUBLE), 4) AS {out}"


def odds_sql(a: str, m: str, b: str, n: str) -> str:
    return f"""CASE WHEN {m} = 0 OR {n} = 0 OR {a} + {b} = 0 OR {a} + {b} = {m} + {n} THEN 'NaN'::DOUBLE
  WHEN {b} = 0 OR {m} = {a} THEN 'Infinity'::DOUBLE
  ELSE ({a} * 1.0::DOUBLE) * ({n} - {b}) / (({b} * 1.0::DOUBLE) * ({m} - {a})) END"""


def t_two_tailed_sql(t: str, df: str, steps: int = 4000) -> str:
    """1 − 2·∫ of Student's density from 0 to |t|, by Simpson's rule."""
    density = (
        f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) "
        f"- ({df} + 1) / 2 * ln(1 + power(abs({t}) * i / {steps}.0, 2) / {df}))")
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return f"greatest(0.0, 1 - 2 * abs({t}) / {steps}.0 / 3 * list_sum(list_transform(range({steps + 1}), lambda i: {weight} * {density})))"


def tested_sql(counts: str = "counts", name: str = "tested") -> str:
    p = ln_fisher_sql("pos_count", "n_pos", "neg_count", "n_neg")
    return f"{name} AS (SELECT *, exp(ln_p) AS pvalue FROM (SELECT token, pos_count, neg_count, n_pos, n_neg, {p} AS ln_p FROM {counts}, sizes))"


def bh_sql(source: str = "tested", name: str = "adjusted", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""{name} AS (SELECT *, exp(ln_padj) AS padj FROM (SELECT *, least(0.0::DOUBLE, min(ln_p + ln(n::DOUBLE / rnk)) OVER ({part}ORDER BY rnk DESC ROWS UNBOUNDED PRECEDING)) AS ln_padj
  FROM (SELECT *, count(*) OVER ({part}) AS n, row_number() OVER ({part}ORDER BY ln_p, token) AS rnk FROM {source})))"""


PROBS = f"""expd AS (
  SELECT vec_id AS motif_id, 'm' || vec_id AS name, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings),
probs AS (
  SELECT motif_id, name, pos, e[pos * 4 + 1] / s AS a, e[pos * 4 + 2] / s AS c, e[pos * 4 + 4] / s AS g, e[pos * 4 + 3] / s AS t
  FROM (SELECT *, e[pos * 4 + 1] + e[pos * 4 + 2] + e[pos * 4 + 3] + e[pos * 4 + 4] AS s
        FROM (SELECT *, unnest(range({WIDTH}))::INTEGER AS pos FROM expd)))"""


def r6_sql(x: str) -> str:
    return f"round({x}, 6)"
