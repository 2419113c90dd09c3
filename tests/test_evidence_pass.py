"""Evidence from one pass over the hits against the single operators, and manifests in one scan."""

import random

import pytest
from pyspark.sql import functions as F

from kmerlake.operators import criteria as C
from kmerlake.plans.evidence import criteria_table
from kmerlake.sources.text import read_manifest, read_manifest_hits

SCHEMA = "gene long, kmer string, a boolean, b boolean, nt_div double"


def tables(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(14), rng.choice(["AA", "AC", "AG", "XX"]), rng.random() < 0.3, False,
             rng.choice([0.0, 0.1, 0.25, float("nan"), None, rng.random()])) for _ in range(600)]
    rows += [(g, "CC", True, g == 1, 0.1) for g in range(6) for _ in range(g)] + [(13, "GG", True, None, 0.3), (None, "AA", True, True, 0.5)]
    hits = spark.createDataFrame(rows, SCHEMA)
    genes = spark.createDataFrame([(g, g % 2) for g in range(12)] + [(13, 0)], "gene long, class int")
    return hits, spark.createDataFrame([("AA",), ("AC",), ("AG",), ("CC",), ("GG",), ("TT",)], "kmer string"), genes


def rows(df):
    def cell(x):
        return str(round(x, 9)) if isinstance(x, float) else x  # NaN as text equals itself
    return {r["kmer"]: {c: cell(r[c]) for c in df.columns} for r in df.collect()}


def test_one_pass_equals_the_single_operators(spark):
    hits, kmers, genes = tables(spark)
    found = C.gene_evidence(hits, kmers, genes, {"a": F.col("a"), "b": F.col("b")}, F.col("nt_div")).cache()
    assert rows(C.copy_columns(found)) == rows(C.copy_evidence(hits, kmers, genes))
    detail = lambda c: hits.select("gene", "kmer", F.when(F.col(c), "overlap=x").otherwise("overlap=NA").alias("details"), F.lit(c).alias("mark"))
    totals = C.copy_number(hits, kmers, genes)
    tagged = detail("a").unionByName(detail("b"))
    assert rows(C.mark_columns(found, ["a", "b"])) == rows(C.feature_enrichment(totals, tagged, ["a", "b"], kmers, genes))
    assert rows(C.diversity_columns(found, "div_")) == rows(C.diversity_evidence(hits, kmers, genes))


def test_diversity_moments_equal_the_plain_ones(spark):
    hits, kmers, genes = tables(spark)
    plain = C.semi_filter(hits, kmers, genes)
    assert rows(C.diversity_welch(hits, kmers, genes)) == rows(C._welch_columns(C._moments(plain, "nt_div")))
    clean = hits.where("not isnan(nt_div) or nt_div is null")
    mean = lambda label: F.avg(F.when(F.col("class") == label, F.col("nt_div")))
    want = C.semi_filter(clean, kmers, genes).groupBy("kmer").agg(mean(1).alias("div_pos"), mean(0).alias("div_neg"))
    assert rows(C.diversity_means(clean, kmers, genes)) == rows(want)
    assert rows(C.diversity_welch(hits, kmers, genes))["CC"]["t"] is None  # equal values have no variance, exactly


def test_the_hits_are_read_once(spark):
    hits, kmers, genes = tables(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    presence = hits.where("gene < 12").select("gene", F.lit(1).alias("class"), F.col("kmer").alias("token")).distinct()
    table = criteria_table(
        presence, genes, hits.mapInPandas(counted, SCHEMA), {"a": F.col("a"), "b": F.col("b"), "own": hits.select("gene", "kmer", F.lit("overlap=y").alias("details"))},
        F.col("nt_div"))
    shown = table.collect()
    assert read.value == hits.count() and len(shown) == presence.select("token").distinct().count()
    assert {"a_odds", "b_pval", "own_ln_p", "copy_t", "div_pval"} <= set(table.columns)


def test_manifest_in_one_scan(spark, tmp_path):
    line = "chr1\t{g}\tAA.TT\t1\t2\t.\t+\t.\t{d}\n"
    (tmp_path / "one + two.txt").write_text(line.format(g="g1", d="overlap=NA") + line.format(g="g2", d="overlap=p"))
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "part-0").write_text(line.format(g="g3", d="overlap=p"))
    (tmp_path / "folder" / "part-1").write_text(line.format(g="g4", d="overlap=p"))
    (tmp_path / "m.tsv").write_text(
        f"k4\tactivator\t{tmp_path}/one + two.txt\nk9\trepressor\tfile://{tmp_path}/folder/\nk27\trepressor\t{tmp_path}/folder\n")
    out = read_manifest_hits(spark, read_manifest(spark, str(tmp_path / "m.tsv")))
    assert sorted((r.mark, r.gene) for r in out.collect()) == [
        ("k27_r", "g3"), ("k27_r", "g4"), ("k4_a", "g1"), ("k4_a", "g2"), ("k9_r", "g3"), ("k9_r", "g4")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    with pytest.raises(Exception, match="no mark for"):
        read_manifest_hits(spark, [("k4", "activator", f"{tmp_path}/fold*")]).collect()
    assert read_manifest_hits(spark, []).count() == 0
