"""Feature selection, sampling and result tables (rows F and M1-M3, M9, M12 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerlake.operators import classify as K
from kmerlake.operators import metrics as M
from kmerlake.operators import presence as P
from kmerlake.operators import sampling as A
from kmerlake.operators import selection as S
from kmerlake.operators import universe as U
from querybook import fixtures as X
from querybook.enrich import SCORED, base_sql, scored
from querybook.evidence import _CHI2

QUERIES, ORACLES = {}, {}
LENGTH = 6


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def held(spark, sf, k=LENGTH):
    return P.presence_stranded(X.sequences(spark, sf), U.canonical_words(spark, k), [k])


def importance(spark, sf):
    scores = S.chi2_scores(held(spark, sf), X.genes(spark, sf))
    return scores.select("feature", X.r6(F.col("chi2")).alias("importance"))


_CHI = f"{base_sql(LENGTH)}, {_CHI2}"
_IMP = f"{_CHI}, imp AS (SELECT feature, round(chi2, 6) AS importance FROM chi)"


@query("f1_chi2_select", f"{_CHI} SELECT feature, round(chi2, 6) AS chi2 FROM chi ORDER BY round(chi2, 6) DESC, feature LIMIT 50")
def f1(spark, sf):
    return S.chi2_select(held(spark, sf), X.genes(spark, sf), 50).select("feature", X.r6(F.col("chi2")).alias("chi2"))


@query("f3_rank_importance", f"{_IMP} SELECT feature, importance FROM imp ORDER BY importance DESC, feature")
def f3(spark, sf):
    return S.rank_importance(importance(spark, sf))


@query("f4_top_n", f"{_IMP} SELECT feature, importance FROM imp ORDER BY importance DESC, feature LIMIT 25")
def f4(spark, sf):
    return S.top_n(importance(spark, sf), 25)


@query("f5_top_percent", f"""{_IMP} SELECT feature, importance FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rnk, count(*) OVER () AS n FROM imp)
WHERE rnk <= floor(n * 10 / 100)""")
def f5(spark, sf):
    return S.top_percent(importance(spark, sf), 10)


@query("f6_importance_cutoff", f"{_IMP} SELECT feature, importance FROM imp WHERE importance >= 5")
def f6(spark, sf):
    return S.importance_cutoff(importance(spark, sf), 5)


@query("f7_project_selected", f"""{_CHI}, top AS (SELECT feature FROM chi ORDER BY round(chi2, 6) DESC, feature LIMIT 50)
SELECT gene, class, token FROM stranded WHERE token IN (SELECT feature FROM top)""")
def f7(spark, sf):
    rows = held(spark, sf)
    return S.project_selected(rows, S.chi2_select(rows, X.genes(spark, sf), 50))


# Replicates of a feature: the scores of the 6-mer classes that share their first four letters.
@query("f8_mean_importance", f"{_CHI} SELECT substr(feature, 1, 4) AS feature, round(avg(chi2), 6) AS importance FROM chi GROUP BY 1")
def f8(spark, sf):
    scores = S.chi2_scores(held(spark, sf), X.genes(spark, sf))
    reps = scores.select(F.substring("feature", 1, 4).alias("feature"), F.col("chi2").alias("importance"))
    return S.mean_importance(reps).select("feature", X.r6(F.col("importance")).alias("importance"))


_MD5 = "md5(gene || ':' || replicate)"


def sample_sql(reps: int) -> str:
    return f"""SELECT replicate, gene, class FROM genes, range(1, {reps + 1}) r(replicate) WHERE class = 1
UNION ALL SELECT replicate, gene, class FROM (SELECT replicate, gene, class, row_number() OVER (PARTITION BY replicate ORDER BY {_MD5}, gene) AS rnk
  FROM genes, range(1, {reps + 1}) r(replicate) WHERE class = 0), sizes WHERE rnk <= n_pos"""


@query("m1_balanced_sample", f"WITH {X.SEQ} SELECT gene, class, replicate::INTEGER AS replicate FROM ({sample_sql(50)})")
def m1(spark, sf):
    return A.balanced_sample(X.genes(spark, sf), 50)


@query("m2_kfold", f"WITH {X.SEQ} SELECT gene, class, ntile(10) OVER (ORDER BY md5(gene || ':5'), gene)::INTEGER AS fold FROM genes")
def m2(spark, sf):
    return A.kfold(X.genes(spark, sf), 10)


@query("m3_stratified_kfold", f"WITH {X.SEQ} SELECT gene, class, ntile(10) OVER (PARTITION BY class ORDER BY md5(CAST(gene AS VARCHAR)), gene)::INTEGER AS fold FROM genes")
def m3(spark, sf):
    return A.stratified_kfold(X.genes(spark, sf), 10)


# Accuracy of each score threshold on each balanced sample, averaged over the samples.
@query("m9_average_scores", f"""{SCORED}, s AS ({sample_sql(10)}),
acc AS (SELECT thr / 10.0::DOUBLE AS threshold, replicate, avg(CASE WHEN (score >= thr / 10.0::DOUBLE) = (s.class = 1) THEN 1.0::DOUBLE ELSE 0 END) AS score
  FROM s JOIN scored USING (gene), range(1, 10) t(thr) GROUP BY 1, 2)
SELECT threshold, round(avg(score), 6) AS score FROM acc GROUP BY 1""")
def m9(spark, sf):
    sample = A.balanced_sample(X.genes(spark, sf), 10)
    rows = sample.join(scored(spark, sf).select("gene", "score"), "gene").select(
        "replicate", "class", "score", F.explode(F.array(*[F.lit(t / 10) for t in range(1, 10)])).alias("threshold"))
    rows = rows.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
    results = M.accuracy_f1(rows, ["replicate", "threshold"]).withColumnRenamed("accuracy", "score")
    return M.average_scores(results, ["threshold"]).select("threshold", X.r6(F.col("score")).alias("score"))


@query("m12_run_summary", f"""{SCORED}, s AS ({sample_sql(10)}),
per AS (SELECT replicate, avg(CASE WHEN predicted = s.class THEN 1.0::DOUBLE ELSE 0 END) AS score FROM s JOIN scored USING (gene) GROUP BY 1)
SELECT 'threshold' AS method, n_pos, n_neg, 1024::BIGINT AS n_features, (SELECT count(*) FROM per) AS replicates,
  (SELECT round(avg(score), 6) FROM per) AS mean, (SELECT round(stddev_pop(score), 6) FROM per) AS sd,
  (SELECT round(stddev_pop(score) / sqrt(count(*)), 6) FROM per) AS se FROM sizes""")
def m12(spark, sf):
    sample = A.balanced_sample(X.genes(spark, sf), 10)
    rows = sample.join(scored(spark, sf).select("gene", "predicted"), "gene")
    per = M.accuracy_f1(rows, ["replicate"]).select("replicate", F.col("accuracy").alias("score"))
    return K.run_summary(per, X.genes(spark, sf), 1024, "threshold").withColumns(
        {c: X.r6(F.col(c)) for c in ("mean", "sd", "se")})
