"""k-mer universe, windows and presence (rows K and P of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerlake.functions.words import reverse_complement
from kmerlake.operators import presence as P
from kmerlake.operators import universe as U
from kmerlake.operators.windows import sequence_kmers
from kmerlake.session import written
from querybook import fixtures as X

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("k1_kmer_universe", f"""WITH {X.SEQ}, {X.windows_sql(4)}, {X.universe_sql(4)}
SELECT u.idx, u.word, count(w.word) AS n FROM universe u LEFT JOIN wins w ON u.word = w.word GROUP BY 1, 2""")
def k1(spark, sf):
    found = sequence_kmers(X.sequences(spark, sf), 4).groupBy("word").agg(F.count("*").alias("n"))
    return U.kmer_universe(spark, 4).join(found, "word", "left").select("idx", "word", F.coalesce("n", F.lit(0)).alias("n"))


_PAIRS = f"""{X.universe_sql(4)},
pairs AS (SELECT a.word AS first, b.word AS second, a.word || ' ' || b.word AS token FROM universe a JOIN universe b ON a.idx < b.idx)"""


def canon_sql(k: int) -> str:
    """Strand classes of k-mers and all their pairs."""
    return f"""{X.universe_sql(k)},
units AS (SELECT idx, word, {X.token_sql('word')} AS token FROM universe WHERE word = {X.canon_sql('word')}),
pairs AS (SELECT a.token AS first, b.token AS second, a.word AS fa, b.word AS fb, a.token || ' ' || b.token AS token
  FROM units a JOIN units b ON a.idx < b.idx)"""


_CANON = canon_sql(4)
_FWD = f"{X.windows_sql(4)}, present AS (SELECT DISTINCT gene, class, word FROM wins)"
_HELD = "SELECT p.gene, p.class, t.token FROM pairs t JOIN present p ON p.word = t.first JOIN present q ON q.gene = p.gene AND q.word = t.second"
_UNITS = f"{X.windows_sql(4)}, present AS (SELECT DISTINCT gene, class, {X.token_sql('word')} AS word FROM (SELECT DISTINCT gene, class, word FROM wins))"
_BY_TOKEN = "token, count(*) AS n_genes, min(gene) AS first_gene, max(gene) AS last_gene, sum(gene)::BIGINT AS sum_genes"
_COUNTED = """SELECT t.token, count(*) FILTER (h.class = 1) AS pos_count, count(*) FILTER (h.class = 0) AS neg_count
FROM pairs t LEFT JOIN ({}) h ON h.token = t.token GROUP BY 1"""


def _by_token(rows):
    """The genes of each token in a few numbers."""
    return rows.groupBy("token").agg(
        F.count("*").alias("n_genes"), F.min("gene").alias("first_gene"), F.max("gene").alias("last_gene"), F.sum("gene").alias("sum_genes"))


@query("k2_kmer_pairs", f"WITH {X.SEQ}, {_PAIRS}, {_FWD} {_COUNTED.format(_HELD)}")
def k2(spark, sf):
    return P.pair_class_counts(X.sequences(spark, sf), 4, stranded=False)


@query("k3_canonical_kmers", f"""WITH {X.SEQ}, {X.windows_sql(4)}, {X.universe_sql(4)},
units AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS rank, word, {X.token_sql('word')} AS token FROM universe WHERE word = {X.canon_sql('word')}),
found AS (SELECT token, sum(n)::BIGINT AS n FROM (SELECT {X.token_sql('word')} AS token, n FROM (SELECT word, count(*) AS n FROM wins GROUP BY 1)) GROUP BY 1)
SELECT u.rank, u.word, u.token, coalesce(f.n, 0) AS n FROM units u LEFT JOIN found f ON u.token = f.token""")
def k3(spark, sf):
    from kmerlake.functions.words import strand_token
    # Written (a row for each word): Spark would test the token for null at every window, before they are counted.
    words = written(sequence_kmers(X.sequences(spark, sf), 4).groupBy("word").agg(F.count("*").alias("n")), "words")
    found = words.groupBy(strand_token(F.col("word")).alias("token")).agg(F.sum("n").alias("n"))
    return U.canonical_kmers(spark, 4).join(found, "token", "left").select("rank", "word", "token", F.coalesce("n", F.lit(0)).alias("n"))


@query("k4_canonical_pairs", f"WITH {X.SEQ}, {_CANON}, {_UNITS} {_COUNTED.format(_HELD)}")
def k4(spark, sf):
    return P.pair_class_counts(X.sequences(spark, sf), 4)


@query("k4_canonical_pairs_6", f"""WITH {X.SEQ}, {canon_sql(6)}, {X.windows_sql(6)},
present AS (SELECT DISTINCT gene, class, idx FROM (SELECT DISTINCT gene, class, {X.token_sql('word')} AS token FROM (SELECT DISTINCT gene, class, word FROM wins)) JOIN units USING (token)),
held AS (SELECT p.idx AS i, q.idx AS j, count(*) FILTER (p.class = 1) AS pos_count, count(*) FILTER (p.class = 0) AS neg_count
  FROM present p JOIN present q ON q.gene = p.gene AND p.idx < q.idx GROUP BY 1, 2)
SELECT a.token AS first, count(h.i) AS n_pairs, coalesce(sum(pos_count), 0)::BIGINT AS pos_sum, coalesce(sum(neg_count), 0)::BIGINT AS neg_sum,
  coalesce(max(pos_count), 0)::BIGINT AS pos_max, coalesce(sum(pos_count * pos_count), 0)::BIGINT AS pos_squares
FROM units a LEFT JOIN held h ON h.i = a.idx GROUP BY 1""")
def k4_6(spark, sf):
    """All 2,162,160 pairs of strand classes of 6-mers, told by their first member."""
    counted = P.pair_class_counts(X.sequences(spark, sf), 6)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias
    told = counted.groupBy(F.substring_index("token", " ", 1).alias("first")).agg(
        F.count_if(F.col("pos_count") + F.col("neg_count") > 0).alias("n_pairs"), F.sum("pos_count").alias("pos_sum"),
        F.sum("neg_count").alias("neg_sum"), F.max("pos_count").alias("pos_max"), F.sum(F.col("pos_count") * F.col("pos_count")).alias("pos_squares"))
    every = U.canonical_words(spark, 6).select(F.col("token").alias("first"))
    return every.join(told, "first", "left").select(
        "first", *[zero(F.col(c))(c) for c in ("n_pairs", "pos_sum", "neg_sum", "pos_max", "pos_squares")])


@query("k5_reverse_complement", f"""WITH {X.SEQ}
SELECT gene, length(seq) AS n, md5({X.rc_sql('seq')}) AS rc_md5 FROM sequences""")
def k5(spark, sf):
    return X.sequences(spark, sf).select(
        "gene", F.length("seq").cast("long").alias("n"), F.md5(reverse_complement(F.col("seq"))).alias("rc_md5"))


@query("k6_sequence_kmers", f"""WITH {X.SEQ}, {X.windows_sql(6)}
SELECT gene, count(*) AS n_windows, count(DISTINCT word) AS n_words, sum(start)::BIGINT AS sum_start,
  min(word) AS first_word, max_by(word, start) AS last_word FROM wins GROUP BY 1""")
def k6(spark, sf):
    # Words are added up by gene in numbers first: text in an aggregate would have every window sorted.
    words = sequence_kmers(X.sequences(spark, sf).drop("class"), 6).groupBy("gene", "word").agg(
        F.count("*").alias("n"), F.sum("start").alias("sum_start"), F.max("start").alias("last"))
    return words.groupBy("gene").agg(
        F.sum("n").alias("n_windows"), F.count("word").alias("n_words"), F.sum("sum_start").alias("sum_start"),
        F.min("word").alias("first_word"), F.max_by("word", "last").alias("last_word"))


@query("p1_presence_single", f"WITH {X.SEQ}, {X.windows_sql(3)} SELECT DISTINCT gene, word AS token FROM wins")
def p1(spark, sf):
    kmers = U.kmer_universe(spark, 3).select(F.col("word").alias("token"))
    return P.presence_single(X.sequences(spark, sf), kmers, [3]).select("gene", "token")


@query("p2_presence_stranded", f"WITH {X.SEQ}, {X.stranded_sql(4, 'sequences')} SELECT gene, token FROM stranded")
def p2(spark, sf):
    return P.presence_stranded(X.sequences(spark, sf), U.canonical_words(spark, 4), [4]).select("gene", "token")


@query("p3_presence_pair", f"WITH {X.SEQ}, {_PAIRS}, {_FWD} SELECT {_BY_TOKEN} FROM ({_HELD}) GROUP BY 1")
def p3(spark, sf):
    return _by_token(P.presence_pair(X.sequences(spark, sf), U.kmer_pairs(spark, 4), [4]))


@query("p4_presence_pair_stranded", f"WITH {X.SEQ}, {_CANON}, {_UNITS} SELECT {_BY_TOKEN} FROM ({_HELD}) GROUP BY 1")
def p4(spark, sf):
    return _by_token(P.presence_pair_stranded(X.sequences(spark, sf), U.canonical_pairs(spark, 4), [4]))


@query("p4_presence_pair_stranded_literal", f"""WITH {X.SEQ}, {canon_sql(3)}, {X.windows_sql(3)},
sets AS (SELECT gene, list(DISTINCT word) AS ws FROM wins GROUP BY 1)
SELECT {_BY_TOKEN} FROM sets, pairs WHERE list_contains(ws, fa)
  OR (list_contains(ws, {X.rc_sql('fa')}) AND list_contains(ws, fb)) OR list_contains(ws, {X.rc_sql('fb')}) GROUP BY 1""")
def p4_literal(spark, sf):
    return _by_token(P.presence_pair_stranded(
        X.sequences(spark, sf), U.canonical_pairs(spark, 3), [3], precedence="literal"))


@query("p5_with_structure", f"""WITH {X.SEQ}, {X.stranded_sql(4)}
SELECT m.gene, m.class, m.n_tokens, {', '.join(f'round(e.embedding[{i}]::DOUBLE, 6) AS ds{i}' for i in range(1, 6))}
FROM (SELECT gene, class, count(*) AS n_tokens FROM stranded GROUP BY 1, 2) m LEFT JOIN embeddings e ON e.vec_id = m.gene""")
def p5(spark, sf):
    held = P.presence_stranded(X.sequences(spark, sf), U.canonical_words(spark, 4), [4])
    matrix = held.groupBy("gene", "class").agg(F.count("*").alias("n_tokens"))
    structure = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("gene"), *[
        X.r6(F.col("embedding")[i].cast("double")).alias(f"ds{i + 1}") for i in range(5)])
    return P.with_structure(matrix, structure)


@query("p6_presence_matrix", f"""WITH {X.SEQ}, {canon_sql(3)}, {X.windows_sql(3, 'sequences')},
fwd AS (SELECT DISTINCT gene, class, word FROM wins),
both2 AS (SELECT DISTINCT gene, class, {X.token_sql('word')} AS word FROM fwd),
fpairs AS (SELECT a.word AS first, b.word AS second, a.word || ' ' || b.word AS token FROM universe a JOIN universe b ON a.idx < b.idx)
SELECT {_BY_TOKEN} FROM (SELECT gene, class, word AS token FROM fwd
UNION ALL SELECT gene, class, word FROM both2
UNION ALL SELECT p.gene, p.class, t.token FROM fpairs t JOIN fwd p ON p.word = t.first JOIN fwd q ON q.gene = p.gene AND q.word = t.second
UNION ALL SELECT p.gene, p.class, t.token FROM pairs t JOIN both2 p ON p.word = t.first JOIN both2 q ON q.gene = p.gene AND q.word = t.second) GROUP BY 1""")
def p6(spark, sf):
    tokens = U.kmer_universe(spark, 3).select(F.col("word").alias("token"))
    for more in (U.canonical_words(spark, 3), U.kmer_pairs(spark, 3), U.canonical_pairs(spark, 3)):
        tokens = tokens.unionByName(more.select("token"))
    return _by_token(P.presence_matrix(X.sequences(spark, sf), tokens, [3]))


@query("p7_feature_subset", f"""WITH {X.SEQ}, {X.stranded_sql(4)}, {X.counts_sql()}
SELECT gene, class, token FROM stranded WHERE token IN (SELECT token FROM counts WHERE pos_count * 7 >= neg_count)""")
def p7(spark, sf):
    from kmerlake.operators.enrichment import class_counts
    held = P.presence_stranded(X.sequences(spark, sf), U.canonical_words(spark, 4), [4])
    return P.feature_subset(held, class_counts(held).where("pos_count * 7 >= neg_count"))


@query("p8_recode_class", """SELECT doc_id AS gene, CASE lang WHEN 'en' THEN 1 ELSE 0 END AS class, source, n_chars
FROM documents WHERE lang IN ('en', 'fr')""")
def p8(spark, sf):
    rows = X.table(spark, sf, "documents").select(F.col("doc_id").alias("gene"), F.col("lang").alias("class"), "source", "n_chars")
    return P.recode_class(rows, "en", "fr")
