"""Universe, windows, presence and growth."""

import random

from pyspark.sql import functions as F

from kmerlake.functions.words import PIECE, reverse_complement
from kmerlake.operators import growth as G
from kmerlake.operators import presence as P
from kmerlake.operators import universe as U
from kmerlake.operators.windows import map_kmers, sequence_kmers, words_in
from kmerlake.operators.enrichment import enrich


def rc(word):
    return word[::-1].translate(str.maketrans("ACGT", "TGCA"))


def seqs(spark, rows):
    return spark.createDataFrame(rows, "gene long, class int, seq string")


def values(df, *columns):
    return {tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()}


def test_universe(spark):
    words = [r.word for r in U.kmer_universe(spark, 2).orderBy("idx").collect()]
    assert words[:5] == ["AA", "AT", "AG", "AC", "TA"] and len(set(words)) == 16
    pairs = [r.token for r in U.kmer_pairs(spark, 2).collect()]
    assert set(pairs) == {f"{a} {b}" for i, a in enumerate(words) for b in words[i + 1:]} and len(pairs) == 120
    assert U.kmer_pairs(spark, 6).count() == 8386560


def test_canonical_classes(spark):
    for k, n in ((2, 10), (3, 32), (4, 136)):
        rows = U.canonical_kmers(spark, k).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range(n)) == list(range(U.canonical_size(k)))
        assert len({min(r.word, rc(r.word)) for r in rows}) == n
        assert all(r.token == f"{r.word}.{rc(r.word)}" for r in rows)
    assert U.canonical_pairs(spark, 2).distinct().count() == 45


def test_reverse_complement(spark):
    assert spark.range(1).select(reverse_complement(F.lit("AACGTNRa")).alias("x")).first().x == "tYNACGTT"


def test_windows_cross_piece_borders(spark):
    random.seed(2)
    text = "".join(random.choice("ACGT") for _ in range(2 * PIECE + 3))
    rows = [(1, 1, text), (2, 0, text[: PIECE + 4]), (3, 0, text[:PIECE]), (4, 0, "ACG"), (5, 0, "ACGTA"), (6, 0, "")]
    df = seqs(spark, rows)
    got = sorted((r.gene, r.start, r.word) for r in sequence_kmers(df, 5).collect())
    assert got == sorted((g, i + 1, s[i:i + 5]) for g, _, s in rows for i in range(len(s) - 4))
    found = values(words_in(df, [3, 5]), "gene", "word")
    assert found == {(g, s[i:i + k]) for g, _, s in rows for k in (3, 5) for i in range(len(s) - k + 1)}


def test_presence_shapes(spark):
    rows = [(1, 1, "AACCGG"), (2, 0, "TTTTGG"), (3, 0, "xAAb"), (4, 1, "aacc")]
    tokens = ["AA", "AA.TT", "AA CC", "AA.TT CC.GG"]
    df = seqs(spark, rows)
    got = values(P.presence_matrix(df, spark.createDataFrame([(t,) for t in tokens], "token string")), "gene", "token")
    has = lambda s, t: all(any(w in s for w in part.split(".")) for part in t.split(" "))
    assert got == {(g, t) for g, _, s in rows for t in tokens if has(s, t)}


def test_pair_precedence(spark):
    df = seqs(spark, [(1, 1, "GAAG"), (2, 1, "GTTCC"), (3, 1, "AGGA"), (4, 0, "GTTG"), (5, 0, "AACC")])
    pairs = spark.createDataFrame([("AA.TT CC.GG",)], "token string")
    assert values(P.presence_pair_stranded(df, pairs), "gene") == {2, 5}
    # F1, or R1 and F2, or R2
    assert values(P.presence_pair_stranded(df, pairs, precedence="literal"), "gene") == {1, 2, 3, 5}


def test_presence_is_symmetric_under_reverse_complement(spark):
    random.seed(5)
    rows = [(i, 1, "".join(random.choice("ACGT") for _ in range(30))) for i in range(20)]
    tokens = U.canonical_words(spark, 3)
    one = values(P.presence_stranded(seqs(spark, rows), tokens), "gene", "token")
    two = values(P.presence_stranded(seqs(spark, [(g, c, rc(s)) for g, c, s in rows]), tokens), "gene", "token")
    assert one == two


def test_map_kmers(spark):
    df = seqs(spark, [(1, 1, "AACTTAC")])
    kmers = spark.createDataFrame([("AA",), ("TTA",)][:1], "kmer string")
    assert values(map_kmers(df, kmers, 2), "start", "end", "dir") == {(1, 2, "+"), (4, 5, "-")}


def test_growth(spark):
    one = spark.createDataFrame([("AAC",)], "token string")
    assert values(G.extend(one), "token") == set("AACA AACT AACG AACC AAAC TAAC GAAC CAAC".split())
    random.seed(6)
    base = lambda n: "".join(random.choice("ACGT") for _ in range(n))
    rows = [(i, 1, base(10) + "GATTACA" + base(10)) for i in range(30)] + [(100 + i, 0, base(27)) for i in range(30)]
    df = seqs(spark, rows)
    grown = G.grow(df, U.canonical_words(spark, 4).select(F.col("word").alias("token")), 7, 0.01, None, [4])
    out = grown.collect()
    p = {r.token: (r.level, r.padj) for r in out}
    assert any(t in p for t in ("GATTACA", rc("GATTACA")))
    for token, (level, padj) in p.items():
        assert padj <= 0.01
        if level:
            parents = [t for t in (token[1:], token[:-1]) if t in p and p[t][0] == level - 1]
            assert any(padj <= p[t][1] for t in parents)
    for r in out:
        hits = lambda c: sum(r.token in s or rc(r.token) in s for _, k, s in rows if k == c)
        assert (r.pos_count, r.neg_count) == (hits(1), hits(0))
    assert G.final_matrix(df, grown, 0.01, positive="yes", negative="no").select("class").distinct().count() <= 2


def test_growth_of_pairs(spark):
    rows = [(i, 1, "GGAACCTTGGCCAA") for i in range(12)] + [(50 + i, 0, "GAGAGAGAGAGA") for i in range(12)]
    seeds = spark.createDataFrame([("AACC GGCC",)], "token string")
    grown = G.grow(seqs(spark, rows), seeds, 1, 0.01)
    assert {r.token for r in grown.collect() if r.level == 0} == {"AACC GGCC"}
    assert "AACC GGCCA" in {r.token for r in grown.collect() if r.level == 1}


def test_enrich_keeps_zero_counts(spark):
    rows = [(i, 1, "AAAA") for i in range(8)] + [(20 + i, 0, "CGCG") for i in range(8)]
    kept, matrix = enrich(seqs(spark, rows), spark.createDataFrame([("AA",), ("GG",)], "token string"), 0.01, True)
    assert values(kept, "token") == {"AA"} and matrix.count() == 8


def test_gene_words_are_distinct_over_rows_stretches_and_nulls(spark, monkeypatch):
    """Genes of one row are not shuffled word by word; repeated and null keys, long sequences and odd letters count once all the same."""
    from kmerlake.operators import gene_words as W
    from kmerlake.operators.presence import presence_single, presence_stranded
    rows = [(1, 1, "ACGTACGGN"), (2, 0, "acgtTTACG"), (2, 0, "TTACGCCA"), (2, 1, "TTA"), (None, 1, "GATTACA"), (None, 1, "TTACAG"), (3, None, "ACG"),
            (4, 0, "ACGTTGCATTACGGCA" * 3), (5, 0, ""), (6, 1, None), (7, 0, "AéGTTéG")]
    seqs = spark.createDataFrame(rows, "gene long, class int, seq string")
    rc = lambda w: w.translate(W._COMPLEMENT)[::-1]
    words = [(g, c, s[i:i + 3]) for g, c, s in rows for i in range(len(s or "") - 2)]
    want = {True: {(g, c, min(w, rc(w))) for g, c, w in words}, False: set(words)}
    for stretch in (1_000_000, 10):
        monkeypatch.setattr(W, "STRETCH", stretch)
        for both in (False, True):
            got = [tuple(r) for r in W.gene_words(seqs, [3], both).collect()]
            assert len(got) == len(set(got)) and set(got) == want[both]
    tokens = spark.createDataFrame([("TTA.TAA",), ("TAA",), ("TTA.TAA",), ("ACG",)], "token string")
    got = sorted(tuple(r) for r in presence_stranded(seqs, tokens, [3]).where("class is not null and gene is not null").collect())
    hold = {t: {t[:3], rc(t[:3])} for t in ("TTA.TAA", "TAA", "ACG")}
    assert got == sorted({(g, c, t) for g, c, w in words if g and c is not None for t in hold if w in hold[t]})
    got = sorted(tuple(r) for r in presence_single(seqs, tokens, [3]).where("gene = 2").collect())
    assert got == sorted({(g, c, w) for g, c, w in words if g == 2 and w in ("TAA", "ACG")})


def test_presence_of_single_rows_shuffles_no_words(spark):
    """The rows of genes that stand alone reach the join without an exchange of their own."""
    from kmerlake.operators.presence import presence_stranded
    seqs = spark.createDataFrame([(1, 1, "ACGTACGG")], "gene long, class int, seq string")
    tokens = spark.createDataFrame([("ACG.CGT",)], "token string")
    plan = presence_stranded(seqs, tokens, [3])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Aggregate [gene")


def test_growth_by_one_level_keeps_no_places(spark):
    """Children are counted by the words of the genes: no Python pass hands back a place or a row to make distinct for genes of one row."""
    from kmerlake.operators.growth import grow_level
    seqs = spark.createDataFrame([(1, 1, "ACGTACGG"), (2, 0, "TTTT"), (3, 1, "CCGTACC")], "gene long, class int, seq string")
    parents = spark.createDataFrame([("ACG", 1.0)], "token string, padj double")
    out = grow_level(seqs, parents, 1.0, None, [4])
    assert "starts" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["token"], r["pos_count"], r["neg_count"]) for r in out.collect()} >= {("ACGT", 1, 0), ("TACG", 2, 0), ("ACGG", 2, 0)}
