"""Class counts, exact tests, metrics and growth (rows E and G of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerlake.operators import enrichment as E
from kmerlake.operators import growth as G
from kmerlake.operators import metrics as M
from kmerlake.operators import presence as P
from kmerlake.operators import universe as U
from kmerlake.operators.windows import words_in
from kmerlake.session import materialise, written
from querybook import fixtures as X
from querybook.words import canon_sql

QUERIES, ORACLES = {}, {}
K = 6


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def counts(spark, sf, k: int = K):
    tokens = U.canonical_words(spark, k).select("token")
    return E.class_counts(P.presence_stranded(X.sequences(spark, sf), tokens, [k]), tokens)


def sizes(spark, sf):
    return E.class_sizes(X.genes(spark, sf))


log_p, log_p_sql = X.log_p, X.log_p_sql


def base_sql(k: int = K) -> str:
    """CTEs up to ``tested`` for all strand classes of length k."""
    return f"""WITH {X.SEQ}, {X.stranded_sql(k)}, {X.counts_sql('stranded', 'seen')}, {X.universe_sql(k)},
counts AS (SELECT u.token, coalesce(s.pos_count, 0) AS pos_count, coalesce(s.neg_count, 0) AS neg_count
  FROM (SELECT {X.token_sql('word')} AS token FROM universe WHERE word = {X.canon_sql('word')}) u LEFT JOIN seen s ON s.token = u.token),
{X.tested_sql()}"""


COUNTED = ["token", "pos_count", "neg_count", "n_pos", "n_neg"]
COUNTED_SQL = ", ".join(COUNTED)


@query("e1_class_counts", f"{base_sql()} SELECT token, pos_count, neg_count FROM tested")
def e1(spark, sf):
    return counts(spark, sf)


@query("e2_fisher_greater", f"{base_sql()} SELECT {COUNTED_SQL}, round(pvalue, 6) AS pvalue, {log_p_sql()} FROM tested")
def e2(spark, sf):
    return E.fisher_greater(counts(spark, sf), sizes(spark, sf)).select(*COUNTED, X.r6(F.col("pvalue")).alias("pvalue"), log_p())


_BALANCED = X.ln_fisher_sql("pos_count", "half", "neg_count", "half")


@query("e3_fisher_balanced", f"""{base_sql()}
SELECT token, pos_count, neg_count, round(exp(ln_p), 6) AS pvalue, {log_p_sql()}
FROM (SELECT token, pos_count, neg_count, CASE WHEN pos_count > half OR neg_count > half THEN 0.0::DOUBLE ELSE {_BALANCED} END AS ln_p
  FROM (SELECT * EXCLUDE (ln_p), (n_pos + n_neg) // 2 AS half FROM tested))""")
def e3(spark, sf):
    return E.fisher_balanced(counts(spark, sf), sizes(spark, sf)).select(
        "token", "pos_count", "neg_count", X.r6(F.col("pvalue")).alias("pvalue"), log_p())


_ARGS = ("pos_count", "n_pos", "neg_count", "n_neg")


@query("e4_fisher_two_sided", f"""{base_sql()}
SELECT {COUNTED_SQL}, odds, round(exp(ln_two), 6) AS pvalue, {log_p_sql('ln_two')}
FROM (SELECT *, round({X.odds_sql(*_ARGS)}, 6) AS odds, {X.ln_fisher_two_sql(*_ARGS)} AS ln_two FROM tested)""")
def e4(spark, sf):
    return E.fisher_two_sided(counts(spark, sf), sizes(spark, sf)).select(
        *COUNTED, X.r6(F.col("odds")).alias("odds"), X.r6(F.col("pvalue")).alias("pvalue"), log_p())


@query("e5_filter_enriched", f"{base_sql()} SELECT token, pos_count, neg_count, round(pvalue, 6) AS pvalue, {log_p_sql()} FROM tested WHERE pvalue <= 0.05")
def e5(spark, sf):
    tested = E.fisher_greater(counts(spark, sf), sizes(spark, sf))
    return E.filter_enriched(tested, 0.05).select("token", "pos_count", "neg_count", X.r6(F.col("pvalue")).alias("pvalue"), log_p())


@query("e6_bh_adjust", f"{base_sql()}, {X.bh_sql()} SELECT token, round(pvalue, 6) AS pvalue, round(padj, 6) AS padj, {log_p_sql('ln_padj')} FROM adjusted")
def e6(spark, sf):
    tested = E.fisher_greater(counts(spark, sf), sizes(spark, sf))
    return E.bh_adjust(tested).select("token", X.r6(F.col("pvalue")).alias("pvalue"), X.r6(F.col("padj")).alias("padj"), log_p("ln_padj"))


@query("e6_bh_adjust_families", f"""{base_sql()}, families AS (SELECT *, substr(token, 1, 2) AS family FROM tested),
{X.bh_sql('families', by='family')} SELECT family, token, round(padj, 6) AS padj, {log_p_sql('ln_padj')} FROM adjusted""")
def e6_families(spark, sf):
    tested = E.fisher_greater(counts(spark, sf), sizes(spark, sf)).withColumn("family", F.substring("token", 1, 2))
    return E.bh_adjust(tested, ["family"]).select("family", "token", X.r6(F.col("padj")).alias("padj"), log_p("ln_padj"))


def flagship(spark, sf):
    """Which strand classes of 6-mers are enriched in the positives, adjusted, best first."""
    tokens = U.canonical_words(spark, K).select("token")
    kept, _ = E.enrich(X.sequences(spark, sf), tokens, 0.01, True, [K])
    return kept.select(
        *COUNTED, X.r6(F.col("pvalue")).alias("pvalue"), X.r6(F.col("padj")).alias("padj"), log_p(),
    ).orderBy(F.desc("log_p"), "token")


@query("e7_enrich", f"""{base_sql()}, {X.bh_sql()}
SELECT {COUNTED_SQL}, round(pvalue, 6) AS pvalue, round(padj, 6) AS padj, {log_p_sql()} FROM adjusted WHERE padj <= 0.01""")
def e7(spark, sf):
    return flagship(spark, sf)


@query("e7_enrich_matrix", f"""{base_sql(4)}
SELECT gene, class, token FROM stranded WHERE token IN (SELECT token FROM tested WHERE pvalue <= 0.01)""")
def e7_matrix(spark, sf):
    tokens = U.canonical_words(spark, 4).select("token")
    return E.enrich(X.sequences(spark, sf), tokens, 0.01, False, [4])[1]


def _pair_tests(spark, sf):
    return E.bh_adjust(E.fisher_greater(P.pair_class_counts(X.sequences(spark, sf), 4), sizes(spark, sf)))


_PAIR_TESTS = f"""WITH {X.SEQ}, {canon_sql(4)}, {X.windows_sql(4)},
present AS (SELECT DISTINCT gene, class, {X.token_sql('word')} AS word FROM (SELECT DISTINCT gene, class, word FROM wins)),
held AS (SELECT p.gene, p.class, t.token FROM pairs t JOIN present p ON p.word = t.first JOIN present q ON q.gene = p.gene AND q.word = t.second),
counts AS (SELECT t.token, count(*) FILTER (h.class = 1) AS pos_count, count(*) FILTER (h.class = 0) AS neg_count
  FROM pairs t LEFT JOIN held h ON h.token = t.token GROUP BY 1),
{X.tested_sql()}, {X.bh_sql()}, kept AS (SELECT * FROM adjusted WHERE padj <= 0.01)"""


@query("e7_enrich_pairs", f"{_PAIR_TESTS} SELECT {COUNTED_SQL}, round(padj, 6) AS padj, {log_p_sql('ln_padj')} FROM kept")
def e7_pairs(spark, sf):
    """Pairs of strand classes that are enriched in the positives, all 9,180 of 4-mers tested."""
    return E.filter_enriched(_pair_tests(spark, sf), 0.01, "padj").select(*COUNTED, X.r6(F.col("padj")).alias("padj"), log_p("ln_padj"))


def by_gene(rows, tokens):
    """The tokens of each gene in a few numbers; tokens are numbered in their order, as a least text would sort all rows."""
    numbers = written(tokens.select("token").distinct().orderBy("token").withColumn("n", F.monotonically_increasing_id()), "numbers")
    told = rows.join(numbers, "token").groupBy("gene", "class").agg(
        F.count("*").alias("n_tokens"), F.min("n").alias("first"), F.max("n").alias("last"))
    for end in ("first", "last"):
        told = told.join(numbers.select(F.col("n").alias(end), F.col("token").alias(f"{end}_token")), end)
    return told.select("gene", "class", "n_tokens", "first_token", "last_token")


@query("e7_enrich_pairs_matrix", f"{_PAIR_TESTS} SELECT gene, class, count(*) AS n_tokens, min(token) AS first_token, max(token) AS last_token FROM held WHERE token IN (SELECT token FROM kept) GROUP BY 1, 2")
def e7_pairs_matrix(spark, sf):
    """Which genes hold the enriched pairs: only these are opened to rows."""
    kept = materialise(E.filter_enriched(_pair_tests(spark, sf), 0.01, "padj").select("token"))
    return by_gene(P.presence_pair_stranded(X.sequences(spark, sf), kept, [4]), kept)


def gc(spark, sf):
    share = F.length(F.regexp_replace("seq", "[AT]", "")) / F.length("seq")
    return X.sequences(spark, sf).where("seq <> ''").select("gene", "class", share.alias("gc"))


_GC = f"WITH {X.SEQ}, gc AS (SELECT gene, class, length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq)::DOUBLE AS gc FROM sequences WHERE seq <> '')"


@query("e8_mean_sd_se", f"""{_GC} SELECT class, round(avg(gc), 6) AS mean, round(stddev_pop(gc), 6) AS sd,
round(stddev_pop(gc) / sqrt(count(gc)), 6) AS se FROM gc GROUP BY 1""")
def e8(spark, sf):
    return E.mean_sd_se(gc(spark, sf), "gc", ["class"]).select("class", *[X.r6(F.col(c)).alias(c) for c in ("mean", "sd", "se")])


@query("e9_mean_sd_se_ci", f"""{_GC}, s AS (SELECT class, avg(gc) AS mean, stddev_samp(gc) AS sd, stddev_samp(gc) / sqrt(count(gc)) AS se FROM gc GROUP BY 1)
SELECT class, round(mean, 6) AS mean, round(sd, 6) AS sd, round(se, 6) AS se,
  round(mean - 1.959963984540054 * se, 6) AS ci_lower, round(mean + 1.959963984540054 * se, 6) AS ci_upper FROM s""")
def e9(spark, sf):
    return E.mean_sd_se_ci(gc(spark, sf), "gc", ["class"]).select(
        "class", *[X.r6(F.col(c)).alias(c) for c in ("mean", "sd", "se", "ci_lower", "ci_upper")])


def scored(spark, sf):
    """Score of a gene: the share of all 5-mers that it does not hold."""
    seqs = X.sequences(spark, sf)
    held = words_in(seqs, [5]).select("gene", "word").distinct().groupBy("gene").agg(F.count("*").alias("n"))
    score = 1 - F.coalesce("n", F.lit(0)) / 1024.0
    return X.genes(spark, sf).join(held, "gene", "left").select(
        "gene", "class", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


SCORED = f"""WITH {X.SEQ}, {X.windows_sql(5, 'sequences')},
scored AS (SELECT gene, class, 1 - n / 1024.0::DOUBLE AS score, CASE WHEN 1 - n / 1024.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS predicted
  FROM (SELECT g.gene, g.class, coalesce(h.n, 0) AS n FROM genes g LEFT JOIN
        (SELECT gene, count(DISTINCT word) AS n FROM wins GROUP BY 1) h ON h.gene = g.gene))"""


@query("e10_confusion", f"""{SCORED}, c AS (SELECT count(*) FILTER (predicted = 1 AND class = 1) AS tp, count(*) FILTER (predicted = 0 AND class = 0) AS tn,
  count(*) FILTER (predicted = 1 AND class = 0) AS fp, count(*) FILTER (predicted = 0 AND class = 1) AS fn FROM scored)
SELECT tp, tn, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c""")
def e10(spark, sf):
    out = M.confusion(scored(spark, sf))
    return out.select("tp", "tn", "fp", "fn", *[X.r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("e11_accuracy_f1", f"""{SCORED} SELECT round(avg(CASE WHEN predicted = class THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
  round(2.0::DOUBLE * count(*) FILTER (predicted = 1 AND class = 1) / (count(*) FILTER (predicted = 1) + count(*) FILTER (class = 1)), 6) AS f1 FROM scored""")
def e11(spark, sf):
    return M.accuracy_f1(scored(spark, sf)).select(X.r6(F.col("accuracy")).alias("accuracy"), X.r6(F.col("f1")).alias("f1"))


@query("e12_auc_roc", f"""{SCORED} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auc
FROM (SELECT score FROM scored WHERE class = 1) p, (SELECT score FROM scored WHERE class = 0) n""")
def e12(spark, sf):
    return M.auc_roc(scored(spark, sf)).select(X.r6(F.col("auc")).alias("auc"))


@query("e13_pr_points", f"""{SCORED}, g AS (SELECT score, count(*) FILTER (class = 1) AS pos, count(*) FILTER (class = 0) AS neg FROM scored GROUP BY 1),
r AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(score, 6) AS score, tp::BIGINT AS tp, fp::BIGINT AS fp, round((tp / (tp + fp))::DOUBLE, 6) AS precision, round((tp / n)::DOUBLE, 6) AS recall FROM r""")
def e13(spark, sf):
    return M.pr_points(scored(spark, sf)).select(
        X.r6(F.col("score")).alias("score"), "tp", "fp", X.r6(F.col("precision")).alias("precision"), X.r6(F.col("recall")).alias("recall"))


# -- growth: seeds are all strand classes of length 4, tested on both strands ----------------

SEED = 4
CUTOFF = 0.01


def seeds(spark):
    return U.canonical_words(spark, SEED).select(F.col("word").alias("token"))


def seed_result(spark, sf):
    tested = E.fisher_greater(
        E.class_counts(P.presence_stranded(X.sequences(spark, sf), seeds(spark), [SEED]), seeds(spark)), sizes(spark, sf))
    return materialise(E.unadjusted(E.filter_enriched(tested, CUTOFF)))


def level_sql(level: int, parents: str, family: str | None = None) -> str:
    """CTEs from a parents table (token, ln_padj) to the survivors ``level<n>``."""
    k, n = SEED + level, f"_{level}"
    children = " UNION ALL ".join(
        f"SELECT token AS parent, ln_padj AS parent_ln_padj, {expr} AS token FROM {parents}"
        for b in "ATGC" for expr in (f"token || '{b}'", f"'{b}' || token"))
    adjust = f", {X.bh_sql('linked' + n, 'adj' + n, family)}" if family else f", adj{n} AS (SELECT *, pvalue AS padj, ln_p AS ln_padj FROM linked{n})"
    return f"""{X.windows_sql(k, 'sequences', 'w' + n)}, links{n} AS (SELECT DISTINCT * FROM ({children})),
kids{n} AS (SELECT DISTINCT token FROM links{n}),
tw{n} AS (SELECT token, token AS word FROM kids{n} UNION SELECT token, {X.rc_sql('token')} FROM kids{n}),
pres{n} AS (SELECT DISTINCT w.gene, w.class, t.token FROM (SELECT DISTINCT gene, class, word FROM w{n}) w JOIN tw{n} t ON t.word = w.word),
cnt{n} AS (SELECT k.token, count(*) FILTER (p.class = 1) AS pos_count, count(*) FILTER (p.class = 0) AS neg_count
  FROM kids{n} k LEFT JOIN pres{n} p ON p.token = k.token GROUP BY 1),
{X.tested_sql('cnt' + n, 'test' + n)},
linked{n} AS (SELECT l.parent, l.parent_ln_padj, t.* FROM links{n} l JOIN test{n} t ON t.token = l.token){adjust},
level{level} AS (SELECT token, pos_count, neg_count, min(pvalue) AS pvalue, min(padj) AS padj, min(ln_p) AS ln_p, min(ln_padj) AS ln_padj FROM adj{n}
  WHERE padj <= {CUTOFF} AND ln_padj <= parent_ln_padj GROUP BY 1, 2, 3)"""


def seeds_sql() -> str:
    """CTEs up to the enriched seeds ``level0``; seed tokens are the forward words."""
    return f"""{base_sql(SEED)}, level0 AS (SELECT split_part(token, '.', 1) AS token, pos_count, neg_count, pvalue, pvalue AS padj, ln_p, ln_p AS ln_padj
  FROM tested WHERE pvalue <= {CUTOFF})"""


@query("g1_extend", f"""{seeds_sql()} {' UNION ALL '.join(
    f"SELECT token AS parent, {e} AS token FROM level0" for b in 'ATGC' for e in (f"token || '{b}'", f"'{b}' || token"))}""")
def g1(spark, sf):
    return G.extend(seed_result(spark, sf))


@query("g2_grow_level", f"{seeds_sql()}, {level_sql(1, 'level0')} SELECT token, pos_count, neg_count, round(padj, 6) AS padj, {log_p_sql('ln_padj')} FROM level1")
def g2(spark, sf):
    return G.grow_level(X.sequences(spark, sf), seed_result(spark, sf), CUTOFF, None, [SEED + 1]).select(
        "token", "pos_count", "neg_count", X.r6(F.col("padj")).alias("padj"), log_p("ln_padj"))


@query("g2_grow_level_fdr", f"{seeds_sql()}, {level_sql(1, 'level0', 'parent')} SELECT token, pos_count, neg_count, round(padj, 6) AS padj, {log_p_sql('ln_padj')} FROM level1")
def g2_fdr(spark, sf):
    return G.grow_level(X.sequences(spark, sf), seed_result(spark, sf), CUTOFF, "parent", [SEED + 1]).select(
        "token", "pos_count", "neg_count", X.r6(F.col("padj")).alias("padj"), log_p("ln_padj"))


_LEVELS = 7
_GROWN = f"{seeds_sql()}, " + ", ".join(level_sql(n, f"level{n - 1}") for n in range(1, _LEVELS + 1))
_UNION = " UNION ALL ".join(f"SELECT {n} AS level, token, pos_count, neg_count, pvalue, ln_p FROM level{n}" for n in range(_LEVELS + 1))


def grown(spark, sf):
    return G.grow(X.sequences(spark, sf), seeds(spark), _LEVELS, CUTOFF, None, [SEED])


@query("g3_grow", f"{_GROWN} SELECT level, token, pos_count, neg_count, round(pvalue, 6) AS pvalue, {log_p_sql()} FROM ({_UNION})")
def g3(spark, sf):
    return grown(spark, sf).select("level", "token", "pos_count", "neg_count", X.r6(F.col("pvalue")).alias("pvalue"), log_p())



_ROWS = f"""seedw AS (SELECT token, token AS word FROM level0 UNION SELECT token, {X.rc_sql('token')} FROM level0),
rows AS (SELECT DISTINCT w.gene, w.class, t.token FROM wins w JOIN seedw t ON t.word = w.word
  {' '.join(f"UNION ALL SELECT gene, class, token FROM pres_{n} WHERE token IN (SELECT token FROM level{n})" for n in range(1, _LEVELS + 1))})"""
_TOLD = "SELECT gene, CASE class WHEN 1 THEN 'pos' ELSE 'neg' END AS class, count(*) AS n_tokens, min(token) AS first_token, max(token) AS last_token FROM rows"


def _final(spark, sf, fdr):
    words = grown(spark, sf)
    matrix = G.final_matrix(X.sequences(spark, sf), words, CUTOFF, [SEED + n for n in range(_LEVELS + 1)], "pos", "neg", fdr)
    return by_gene(matrix, words)


@query("g4_final_matrix", f"{_GROWN}, {_ROWS} {_TOLD} GROUP BY 1, 2")
def g4(spark, sf):
    return _final(spark, sf, False)


@query("g4_final_matrix_fdr", f"""{_GROWN}, {_ROWS}, last AS (SELECT token, pvalue, ln_p FROM ({_UNION})), {X.bh_sql('last')}
{_TOLD} WHERE token IN (SELECT token FROM adjusted WHERE padj <= {CUTOFF}) GROUP BY 1, 2""")
def g4_fdr(spark, sf):
    """The last test adjusted over all survivors, which are one family."""
    return _final(spark, sf, True)
