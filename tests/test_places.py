"""Growth by occurrence lists against a plain search, and how often it reads the text."""

import random

import pytest
from pyspark.sql import functions as F

from kmerlake.functions.words import PIECE
from kmerlake.operators import enrichment as E
from kmerlake.operators import growth as G
from kmerlake.operators import places as L

RC = str.maketrans("ACGT", "TGCA")


def rc(word):
    return word.translate(RC)[::-1]


def made(n, size, motif):
    rng = random.Random(n + size)
    text = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    return [(g, g % 2, text(size) + (motif if g % 2 else "") + text(size)) for g in range(n)]


ROWS = made(40, 30, "GATTACATT") + [
    (100, 1, "ACGT" * (PIECE // 4) + "GATTACATTAC"), (101, 1, ""), (102, 0, None), (103, 0, "NNACNGTAN"), (104, 1, "acGATTAÉCA"),
    (7, 1, "GATTACATTGATTACATT"), (None, 0, "GATTACAAC")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "gene long, class int, seq string")


def held(rows, token):
    return {(g, c) for g, c, s in rows if s and (token in s or rc(token) in s)}


def brute(rows, seeds, levels, cutoff, test):
    """{(level, token): (positives, negatives)}; ``test`` gives p for the two counts."""
    count = lambda t: tuple(sum(c == k for _, c in held(rows, t)) for k in (1, 0))
    out, alive = {}, {}
    for t in seeds:
        if (p := test(*count(t))) <= cutoff:
            alive[t] = p
    out.update({(0, t): count(t) for t in alive})
    for level in range(1, levels + 1):
        after = {}
        for parent, bound in alive.items():
            for child in [parent + b for b in "ATGC"] + [b + parent for b in "ATGC"]:
                p = test(*count(child))
                if p <= cutoff and p <= bound * (1 + 1e-12):
                    after[child] = p
        alive = after
        out.update({(level, t): count(t) for t in alive})
    return out


def one_sided(m, n):
    from math import comb

    def p(a, b):
        return sum(comb(m, x) * comb(n, a + b - x) for x in range(a, min(m, a + b) + 1) if a + b - x <= n) / comb(m + n, a + b)

    return p


@pytest.mark.parametrize("seeds", [["GATT", "AATC", "ACGT", "TTTT"], ["GATT", "TACAT", "AC"]])
def test_growth_equals_a_plain_search(spark, seeds):
    m, n = (sum(c == k for _, c, _ in ROWS) for k in (1, 0))
    grown = G.grow(frame(spark), spark.createDataFrame([(t,) for t in seeds], "token string"), 4, 0.05)
    got = {(r.level, r.token): (r.pos_count, r.neg_count) for r in grown.collect()}
    want = brute(ROWS, seeds, 4, 0.05, one_sided(m, n))
    assert got == want and max(level for level, _ in got) == 4
    presence = {(r.gene, r["class"], r.token) for r in G.final_matrix(frame(spark), grown, 0.05, positive="1", negative="0").collect()}
    assert presence == {(g, str(c), t) for _, t in want for g, c in held(ROWS, t)}


def test_a_level_alone_equals_the_loop(spark):
    seeds = spark.createDataFrame([("GATT",), ("TACA",)], "token string")
    loop = G.grow(frame(spark), seeds, 1, 0.05)
    parents = loop.where("level = 0").drop("level")
    alone = G.grow_level(frame(spark), parents, 0.05)
    cells = lambda df: {(r.token, r.pos_count, r.neg_count, round(r.padj, 12)) for r in df.collect()}
    assert cells(alone) == cells(loop.where("level = 1")) != set()
    assert cells(G.grow_level(frame(spark), parents, 0.05, None, [5])) == cells(alone)


def test_the_text_is_read_once_for_all_levels(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    seqs = frame(spark).mapInPandas(counted, "gene long, class int, seq string")
    grown = G.grow(seqs, spark.createDataFrame([("GATT",)], "token string"), 5, 0.05, None, [4])
    assert grown.where("level = 5").count() > 0
    assert read.value == 2 * len(ROWS)  # the class sizes and the text


def test_states_shrink_to_the_neighbourhood_of_their_starts(spark):
    text = "C" * 1000 + "GATTACA" + "C" * 1000 + "GATTACA" + "C" * 1000
    cut = L.cut_text(spark.createDataFrame([(1, 1, text)], "gene long, class int, seq string"), [4], 2)
    tokens = spark.createDataFrame([("GATT",)], "token string")
    state = L.open_places(cut, L.word_bitmap(tokens), [4], 2).collect()
    assert [(r.k, r.text) for r in state] == [(4, "CCGATTAC")] * 2


def test_a_full_bitmap_changes_no_count(spark, monkeypatch):
    """Every start passes; words that no token asks for drop out in the join."""
    tokens = spark.createDataFrame([("GATTA",), ("TACA",), ("GGGGGG",)], "token string")
    full = spark.sparkContext.broadcast(b"\xff" * (1 << (L.BITS - 3)))
    cut = L.cut_text(frame(spark), [4, 5, 6])
    exact = E.class_counts(E.stranded_presence(frame(spark), tokens), tokens).orderBy("token").collect()
    for bitmap in (full, L.word_bitmap(tokens)):
        assert L.counts_at(L.open_places(cut, bitmap, [4, 5, 6], 0), tokens).orderBy("token").collect() == exact


def test_nothing_to_grow(spark):
    none = frame(spark, [])
    seeds = spark.createDataFrame([("GATT",)], "token string")
    assert G.grow(none, seeds, 2).where("level > 0").count() == 0
    assert G.grow(frame(spark), seeds.where(F.lit(False)), 2).count() == 0


def test_words_of_a_gene_in_one_row_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(L, "GAP", 0)  # stretches are many
    tokens = spark.createDataFrame([("GATTA",), ("TACA",), ("ACGT",)], "token string")
    cut = L.cut_text(frame(spark), [4, 5], 1, 1000)
    state = L.with_alone(L.open_places(cut, L.word_bitmap(tokens), [4, 5], 1, True), "k")
    by_gene = {(r.gene, r["class"]): r.alone for r in state.collect()}
    assert not by_gene[7, 1] and not by_gene[100, 1] and by_gene[1, 1] and by_gene[None, 0]
    exact = E.class_counts(E.stranded_presence(frame(spark), tokens), tokens).orderBy("token").collect()
    assert L.counts_at(state, tokens).orderBy("token").collect() == exact
    grown = L.grow_places(state, L.word_bitmap(tokens), 0, together=True)
    assert grown.columns == ["gene", "class", "alone", "k", "text", "starts"]
    once = L.words_at(grown.where("alone"))
    assert once.count() == once.distinct().count()
