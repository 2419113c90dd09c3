"""Rules that keep results whole at any size: no floors, caps, clamps or silent losses."""

import math

import pytest
from pyspark.sql import functions as F

from kmerlake.functions import exact
from kmerlake.operators import distance as D
from kmerlake.operators import enrichment as E
from kmerlake.operators import growth as G
from kmerlake.operators import motifs as W
from kmerlake.operators import presence as P
from kmerlake.operators.criteria import fs_overlap
from kmerlake.operators.ranking import score_bucket
from kmerlake.operators.sampling import stratified_kfold
from kmerlake.operators.windows import map_kmers
from kmerlake.sources import sinks as O


def ln_tail(a, m, b, n):
    ln_c = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    terms = [ln_c(m, x) + ln_c(n, a + b - x) - ln_c(m + n, a + b) for x in range(a, min(m, a + b) + 1)]
    return max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))


def test_p_values_below_the_smallest_double(spark):
    tables = [(2900, 3000, 100, 3000), (2950, 3000, 100, 3000), (3, 10, 2, 10)]
    df = spark.createDataFrame(tables, "a long, m long, b long, n long")
    rows = df.select("*", exact.ln_fisher_greater(*map(F.col, "ambn")).alias("ln"), exact.ln_fisher_two_sided(*map(F.col, "ambn")).alias("two")).collect()
    for r in rows:
        assert r["ln"] == pytest.approx(ln_tail(r["a"], r["m"], r["b"], r["n"]), rel=1e-9)
        assert r["two"] >= r["ln"]
    assert rows[1]["ln"] < rows[0]["ln"] < -400 * math.log(10)
    genes = spark.createDataFrame([(g, int(g < 3000)) for g in range(6000)], "gene long, class int")
    hits = [(1, g) for g in range(2900)] + [(2, g) for g in range(2950)] + [(m, g) for m in (1, 2) for g in range(3000, 3100)]
    rated = W.group_specificity(spark.createDataFrame(hits, "motif_id long, gene long"), genes).withColumn("cluster", F.lit(0))
    assert {r["pvalue"] for r in rated.collect()} == {0.0}
    assert W.top_motif(rated).first()["motif_id"] == 2


def test_growth_prunes_below_the_smallest_double(spark):
    rows = [(g, 1, "AACG" if g < 1980 else "AACT") for g in range(2000)] + [(2000 + g, 0, "GGGG") for g in range(2000)]
    seqs = spark.createDataFrame(rows, "gene long, class int, seq string")
    own = E.unadjusted(E.fisher_greater(spark.createDataFrame([("AAC", 2000, 0)], "token string, pos_count long, neg_count long"), E.class_sizes(seqs)))
    assert own.first()["pvalue"] == 0.0
    kept = {r["token"]: r["ln_padj"] for r in G.grow_level(seqs, own, 0.01).collect()}
    assert "AACT" not in kept and "AACG" not in kept  # both are rarer than their parent, though all p are 0


def test_bh_keeps_rows_without_p(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", None), ("c", 0.04)], "token string, pvalue double")
    got = {r["token"]: r["padj"] for r in E.bh_adjust(df).collect()}
    assert got["b"] is None and got["a"] == pytest.approx(0.02) and got["c"] == pytest.approx(0.04)


def test_scores_spread_over_buckets(spark):
    scores = spark.range(100_000).select((F.col("id") * 0.37 - 10_000).alias("s"))
    rows = scores.select("s", score_bucket(F.col("s")).alias("b"))
    assert rows.select("b").distinct().count() > 10_000
    both = [(r["s"], r["b"]) for r in rows.orderBy("s").collect()]
    assert all(x[1] <= y[1] for x, y in zip(both, both[1:]))


def test_pairs_stay_within_a_class(spark):
    seqs = spark.createDataFrame([(1, 1, "AACT"), (1, 0, "CCT")], "gene long, class int, seq string")
    pairs = spark.createDataFrame([("AA CC",)], "token string")
    assert P.presence_pair(seqs, pairs).count() == 0


def test_mapping_reads_all_lengths_and_tokens(spark):
    seqs = spark.createDataFrame([(1, "ACGTACG" + "T" * 600 + "ACG")], "gene long, seq string")
    kmers = spark.createDataFrame([("AC",), ("ACG",), ("CG.CG",)], "kmer string")
    got = sorted((r["kmer"], r["dir"], r["start"], r["end"]) for r in map_kmers(seqs, kmers).collect())
    plus = [("AC", "+", s, s + 1) for s in (1, 5, 608)] + [("ACG", "+", s, s + 2) for s in (1, 5, 608)]
    minus = [("AC", "-", 3, 4), ("AC", "-", 7, 8), ("ACG", "-", 2, 4), ("ACG", "-", 6, 8)]
    assert got == sorted(plus + minus + [("CG.CG", d, s, s + 1) for d in "+-" for s in (2, 6, 609)])


def test_listed_words_are_the_small_side(spark):
    seqs = spark.createDataFrame([(1, "ACGTACG")], "gene long, seq string")
    for df in (seqs, seqs.union(seqs)):
        plan = map_kmers(df, spark.createDataFrame([("AC",), ("ACG",)], "kmer string"))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "BuildRight" in plan


def test_impossible_letters_do_not_silence_a_motif(spark):
    exact_word = [(0, "w", p, *(1.0 if x == y else 0.0 for y in "ACGT")) for p, x in enumerate("ACGT")]
    odds = W.probs_to_logodds(spark.createDataFrame(exact_word, "motif_id long, name string, pos int, a double, c double, g double, t double"))
    seqs = spark.createDataFrame([(1, "TTACGTTT")], "gene long, seq string")
    assert {(r["start"], r["dir"]) for r in D.scan_motifs(seqs, odds, 0.9).collect()} == {(3, "+"), (3, "-")}


def test_core_and_motifs_without_information(spark):
    flat, sharp = [0.33, 0.17, 0.17, 0.33], [0.97, 0.01, 0.01, 0.01]
    rows = [(0, "m", p, *v) for p, v in enumerate([flat, flat, sharp, sharp, flat])] + [(1, "n", p, *flat) for p in range(2)]
    cells = spark.createDataFrame(rows, "motif_id long, name string, pos int, a double, c double, g double, t double")
    assert sorted((r["motif_id"], r["pos"], r["a"]) for r in W.core(cells, 2).collect()) == [(0, 0, 0.97), (0, 1, 0.97), (1, 0, 0.33), (1, 1, 0.33)]
    assert [r["motif_id"] for r in W.without_information(cells).collect()] == [1]


def test_matrix_of_any_width(spark, tmp_path):
    tokens = O.numbered_tokens(spark.range(3000).select(F.concat(F.lit("T"), "id").alias("token")))
    assert sorted(r["idx"] for r in tokens.collect()) == list(range(3000))
    genes = spark.createDataFrame([(1, 1), (2, 0)], "gene long, class int")
    held = spark.createDataFrame([(1, 1, "T0"), (1, 1, "T2999"), (1, 1, "T7")], "gene long, class int, token string")
    lines = {r["gene"]: r["line"].split("\t") for r in O.matrix_lines(held, genes, tokens).collect()}
    assert len(lines[1]) == len(lines[2]) == 3002 and lines[1].count("1") == 2 + 3 and set(lines[2][2:]) == {"0"}
    O.write_matrix(held, genes, tokens, str(tmp_path / "m"))
    assert {tuple(r) for r in O.read_matrix_rows(spark, str(tmp_path / "m")).collect()} == {("1", "1", t) for t in ("T0", "T7", "T2999")}


def test_selected_words_of_all_lengths_count(spark):
    kmers = spark.createDataFrame([("AACG",), ("TTTT",)], "kmer string")
    chosen = spark.createDataFrame([("ACG",), ("CCCCCC",), ("G",)], "token string")
    assert {tuple(r) for r in fs_overlap(kmers, chosen).collect()} == {("AACG", 1), ("TTTT", 0)}


def test_folds_differ_between_replicates(spark):
    rows = spark.range(200).select(F.col("id").alias("gene"), (F.col("id") % 4 == 0).cast("int").alias("class"), F.explode(F.array(F.lit(1), F.lit(2))).alias("replicate"))
    got = stratified_kfold(rows, 5, by=["replicate"], seeded=True).collect()
    folds = {(r["replicate"], r["gene"]): r["fold"] for r in got}
    assert any(folds[1, g] != folds[2, g] for g in range(200))
    for replicate in (1, 2):
        for fold in range(1, 6):
            inside = [r["class"] for r in got if (r["replicate"], r["fold"]) == (replicate, fold)]
            assert len(inside) == 40 and sum(inside) == 10
