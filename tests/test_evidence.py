"""Criteria, selection, sampling and classifiers on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from kmerlake.operators import classify as K
from kmerlake.operators import criteria as C
from kmerlake.operators import presence as P
from kmerlake.operators import sampling as A
from kmerlake.operators import selection as S


@pytest.fixture(scope="module")
def genes(spark):
    return spark.createDataFrame([(i, int(i < 4)) for i in range(10)], "gene long, class int")


def kmer_table(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "kmer string")


def test_copy_number_and_overlap(spark, genes):
    rows = [("A", 0, "overlap=x"), ("A", 0, "overlap=NA"), ("A", 1, "overlap=x"), ("A", 7, "overlap=NA"),
            ("B", 2, "overlap=NA"), ("B", 8, "overlap=x"), ("C", 9, "overlap=x"), ("A", 99, "overlap=x")]
    hits = spark.createDataFrame(rows, "kmer string, gene long, details string")
    kmers = kmer_table(spark, "A", "B", "C")
    totals = C.copy_number(hits, kmers, genes)
    assert {(r.kmer, r.copy_pos, r.copy_neg, r.hits_pos, r.hits_neg) for r in totals.collect()} == {("A", 1.5, 1.0, 3, 1), ("B", 1.0, 1.0, 1, 1)}
    late = {r.kmer: (r.t1, r.t2, r.t3, r.t4) for r in C.overlap_enrichment(totals, hits, kmers, genes).collect()}
    early = {r.kmer: (r.t1, r.t2, r.t3, r.t4) for r in C.overlap_enrichment(totals, hits, kmers, genes, "early").collect()}
    assert late == {"A": (2, 1, 0, 0), "B": (0, 0, 1, 0)}
    assert early == {"A": (2, 1, 0, 1), "B": (0, 1, 1, 0)}


def test_welch_by_hand(spark, genes):
    div = spark.createDataFrame([("A", g, float(v)) for g, v in enumerate((1, 2, 3, 4, 2, 4, 6, 8))], "kmer string, gene long, nt_div double")
    row = C.diversity_welch(div, kmer_table(spark, "A"), genes).first()
    assert row.t == pytest.approx(-1.7320508) and 0.14 < row.pvalue < 0.16
    few = C.diversity_welch(div.where("gene < 5"), kmer_table(spark, "A"), genes).first()
    assert few.t is None and few.pvalue is None


def test_best_match_ties_and_containment(spark):
    d = spark.createDataFrame([("A", "m2", 1, 0.2), ("A", "m1", 0, 0.2), ("B", "m1", 0, 0.9)], "kmer string, motif string, pos int, d double")
    assert {(r.kmer, r.TFBM, r.TFBM_PCCD) for r in C.best_match(d).collect()} == {("A", "m1", 0.2), ("B", "m1", 0.9)}
    selected = spark.createDataFrame([("ACG",), ("TT",)], "token string")
    out = C.fs_overlap(kmer_table(spark, "AACGA", "GATTG", "CCCCC"), selected, [2, 3])
    assert {(r.kmer, r.fs_overlap) for r in out.collect()} == {("AACGA", 1), ("GATTG", 1), ("CCCCC", 0)}


def test_gene_in_both_lists_appears_twice(spark, genes):
    matrix = spark.createDataFrame([(1, 0), (2, 1)], "gene long, tf int")
    both = C.label_sites(matrix, genes.where("gene = 1"), genes.where("gene in (1, 2)"))
    assert sorted((r.gene, r.Class) for r in both.collect()) == [(1, 0), (1, 1), (2, 0)]


def test_ranking_over_buckets(spark):
    random.seed(2)
    rows = [(f"f{i}", random.choice([0.0, 0.5, 1.0]) if i % 3 else random.uniform(-99, 99)) for i in range(200)]
    imp = spark.createDataFrame(rows, "feature string, importance double")
    want = [f for f, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.feature for r in S.with_rank(imp).orderBy("rank").collect()] == want
    assert {r.feature for r in S.top_percent(imp, 12.4).collect()} == set(want[:24])
    assert [r.feature for r in S.top_n(imp, 5).collect()] == want[:5]


def test_sampling(spark):
    genes = spark.createDataFrame([(i, int(i < 13)) for i in range(101)], "gene long, class int")
    sample = A.balanced_sample(genes, 3).groupBy("replicate", "class").agg(F.countDistinct("gene").alias("n"), F.count("*").alias("m"))
    assert {(r.replicate, r["class"], r.n, r.m) for r in sample.collect()} == {(r, c, 13, 13) for r in (1, 2, 3) for c in (0, 1)}
    sizes = sorted(r["count"] for r in A.kfold(genes, 10).groupBy("fold").count().collect())
    assert sizes == [10] * 9 + [11]
    per = A.stratified_kfold(genes, 10).groupBy("fold", "class").count().collect()
    assert all(r["count"] in (1, 2) if r["class"] else r["count"] in (8, 9) for r in per)
    assert A.kfold(genes.repartition(7), 10).exceptAll(A.kfold(genes, 10)).isEmpty()


def test_classifiers_separate_classes(spark):
    rows = [(i, int(i < 20), t) for i in range(60) for t in (["good"] if i < 20 else ["bad"]) + (["noise"] if i % 2 else [])]
    presence = spark.createDataFrame(rows, "gene long, class int, token string")
    genes = presence.select("gene", "class").distinct()
    vocabulary = ["good", "bad", "noise"]
    vectors = P.feature_vectors(presence, genes, vocabulary)
    scores, importance = K.rf_replicates(vectors, vocabulary, 1, 1, 3, 5)
    assert scores.first()["mean"] > 0.95
    values = {r.feature: r.importance for r in importance.collect()}
    assert sum(values.values()) == pytest.approx(1) and values["noise"] < 0.3
    svc = K.svc_cv_predict(vectors, 1, 3, max_iter=20)
    assert svc.count() == 40 and svc.where("class <> predicted").count() == 0
    lost = {r.feature: r.importance for r in K.permutation_importance(presence, genes, vocabulary, 3, 5).collect()}
    assert set(lost) == set(vocabulary) and lost["noise"] <= max(lost["good"], lost["bad"])
