"""Pairs by bitmaps against brute force, over several blocks and tiles."""

import random
from itertools import combinations

import pytest

from kmerlake.operators import bitmaps as B
from kmerlake.operators import presence as P
from kmerlake.operators import universe as U


def rc(word):
    return word[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 25)))) for i in range(60)]
    rows += [(100, 1, "ACGN" * 3), (101, 0, ""), (102, 1, "aacc")]
    return rows, spark.createDataFrame(rows, "gene long, class int, seq string").repartition(5)


@pytest.mark.parametrize("stranded", [True, False])
@pytest.mark.parametrize("tile", [3, 1024])
def test_counts_of_all_pairs(spark, texts, monkeypatch, stranded, tile):
    monkeypatch.setattr(B, "TILE", tile)
    rows, df = texts
    units = [r.token for r in U.canonical_kmers(spark, 2).orderBy("rank").collect()] if stranded else [r.word for r in U.kmer_universe(spark, 2).orderBy("idx").collect()]
    has = lambda s, unit: any(w in s for w in unit.split("."))
    want = {}
    for a, b in combinations(units, 2):
        both = [c for _, c, s in rows if has(s, a) and has(s, b)]
        want[f"{a} {b}"] = (sum(both), len(both) - sum(both))
    got = {r.token: (r.pos_count, r.neg_count) for r in P.pair_class_counts(df, 2, stranded).collect()}
    assert got == want and any(n for n, _ in want.values())


def test_listed_pairs_of_several_lengths(spark, texts):
    rows, df = texts
    pairs = ["AA CCG", "AC GT", "GT GT", "TTTTTTTT A", "ACG CGT"]
    got = {(r.gene, r.token) for r in P.presence_pair(df, spark.createDataFrame([(p,) for p in pairs], "token string")).collect()}
    assert got == {(g, p) for g, _, s in rows for p in pairs if all(w in s for w in p.split(" "))}
    none = spark.createDataFrame([], "token string")
    assert P.presence_pair(df, none).count() == 0 and P.presence_pair_stranded(df.limit(0), U.canonical_pairs(spark, 2)).count() == 0


def test_text_is_opened_once(spark, texts):
    """The result reads the written units on both sides; the text is no part of its plan."""
    _, df = texts
    for found in (P.presence_pair(df, U.kmer_pairs(spark, 2), [2]), P.presence_pair_stranded(df, U.canonical_pairs(spark, 2), [2], "literal"),
                  P.pair_class_counts(df, 3)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "seq" not in plan and "LogicalRDD" in plan


def test_gene_numbers_fill_blocks(spark):
    seqs = spark.range(70_000).selectExpr("id AS gene", "cast(id % 2 AS int) AS class", "if(id % 3 = 0, 'AC', 'ACA') AS seq")
    words = spark.createDataFrame([("AC", 0), ("CA", 1)], "word string, unit long")
    held = B.held_units(seqs.coalesce(1), words, [2])
    assert held.select("block", "bit").distinct().count() == 70_000 and held.agg({"bit": "max"}).first()[0] < B.BITS
    got = B.pair_counts(held, 2).collect()
    want = [sum(1 for i in range(70_000) if i % 3 and i % 2 == c) for c in (1, 0)]
    assert [(r.i, r.j, r.pos_count, r.neg_count) for r in got] == [(0, 1, *want)]


def test_opened_pairs_meet_their_genes_without_a_shuffle_of_rows(spark):
    """Bitmaps are opened beside the genes of their block: no join and no exchange above them, also over blocks and repeated genes."""
    seqs = spark.range(70_000).selectExpr("id % 69999 AS gene", "cast(id % 2 AS int) AS class", "if(id % 3 = 0, 'AC', 'ACA') AS seq")
    pairs = spark.createDataFrame([("AC CA",), ("AC AC",), ("AC GG",)], "token string")
    found = P.presence_pair(seqs, pairs, [2])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in above and "Repartition" not in above and "bitmap_and_agg" not in plan
    held = {(r[0] % 69_999, r[0] % 2, t) for r in spark.range(70_000).collect() for t in (["AC AC"] if r[0] % 3 == 0 else ["AC AC", "AC CA"])}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(held) and set(rows) == held


@pytest.mark.parametrize("part", [1, 3, 4096])
def test_parts_of_tokens_and_text_keys(spark, texts, monkeypatch, part):
    monkeypatch.setattr(B, "PART", part)
    monkeypatch.setattr(B, "OPENED", 5)
    rows, df = texts
    pairs = [r.token for r in U.kmer_pairs(spark, 1).collect()]
    named = df.selectExpr("if(gene = 7, null, concat('g', gene)) AS gene", "class", "seq")
    got = sorted((r.gene or "", r.token) for r in P.presence_pair(named, U.kmer_pairs(spark, 1), [1]).collect())
    assert got == sorted(("" if g == 7 else f"g{g}", p) for g, _, s in rows for p in pairs if all(w in s for w in p.split(" ")))
