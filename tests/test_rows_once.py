"""Steps over every window or hit: no sort of them, and each row is parsed once."""

import re

from pyspark.sql import functions as F

from querybook import evidence, words
from querybook import fixtures as X

TEXTS = [
    (1, "Der Hund, der -- laut -- bellt;\n\n und noch mehr Hund", "de"), (1, "Der Hund, der -- laut -- bellt;\n\n und noch mehr Hund", "de"),
    (2, "ABcab zZ 123 éß abcabcabc", "en"), (3, None, "en"), (4, "abc", None), (5, "", "de"), (-6, "the cat sat on the mat and the cat", "fr"),
    (None, "no id has this text, but windows", "en")]


def documents(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain(text):
    return "".join(X.BASES[X.AZ.index(c.lower())] for c in text if c.isascii() and c.isalpha())


def test_windows_of_a_gene_are_not_sorted(spark, tmp_path):
    got = words.k6(spark, documents(spark, tmp_path))
    assert not re.search(r"SortAggregate\(key=\[[^\]]*word", plan(got))  # it sorted every window by gene and word
    want = {}
    for gene, text, _ in TEXTS:
        seq = plain(text or "")
        for s in range(len(seq) - 5):
            want.setdefault(gene, []).append((s + 1, seq[s:s + 6]))
    rows = {r["gene"]: tuple(r)[1:] for r in got.collect()}
    assert rows == {g: (len(w), len({x for _, x in w}), sum(s for s, _ in w), min(x for _, x in w), max(w)[1]) for g, w in want.items()}


def test_regions_are_parsed_once_a_hit(spark, tmp_path):
    sf = documents(spark, tmp_path)
    for query in (evidence.c13, evidence.c14):
        shown = plan(query(spark, sf))
        # Null tests of the keys stood below the regions and made and parsed them again.
        assert not re.search(r"isnotnull\((cast\()?element_at\(split", shown)
        assert shown.count("concat(chr1_") == 1


def test_diversity_text_is_that_of_the_number(spark):
    genes = F.when(F.col("id") % 50 > 0, F.col("id") - 150)
    hits = spark.range(300).select(genes.alias("gene"), (F.col("id") * 13 + 1).alias("start"), (F.col("id") * 13 + 4).alias("end"), F.lit("A.T").alias("kmer"))
    value = ((F.col("start") * 31 + F.col("gene")) % 100 / 997.0).cast("string")
    want = hits.select(F.when(F.col("start") % 7 == 0, "NoDiffSites").otherwise(value).alias("v")).collect()
    assert [r["NtDiversity"] for r in X.diversity_text(hits).select("NtDiversity").collect()] == [r["v"] for r in want]


def test_letters_become_bases(spark):
    rows = spark.createDataFrame([(t,) for _, t, _ in TEXTS], "text string").select("text", X.dna(F.col("text")).alias("seq")).collect()
    assert [r["seq"] for r in rows] == [None if r["text"] is None else plain(r["text"]) for r in rows]
