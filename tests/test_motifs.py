"""Distances, clusters, consensus and scans against brute force."""

import random

import numpy as np
import pytest

from kmerlake.operators import clustering as L
from kmerlake.operators import distance as D
from kmerlake.operators import motifs as W


def make(n, seed, widths=(5, 9)):
    rng = np.random.default_rng(seed)
    return {i: rng.dirichlet([0.6] * 4, size=rng.integers(*widths)) for i in range(n)}


def cells(spark, motifs):
    rows = [(int(i), f"m{i}", p, *map(float, v)) for i, m in motifs.items() for p, v in enumerate(m)]
    return spark.createDataFrame(rows, "motif_id long, name string, pos int, a double, c double, g double, t double")


def pearson(x, y):
    x, y = x - x.mean(), y - y.mean()
    s = np.sqrt((x * x).sum() * (y * y).sum())
    return (x * y).sum() / s if s > 1e-12 else 0.0


def brute_distance(a, b):
    best, short = -9.0, min(len(a), len(b))
    need = min(short, max(4, -(-short // 2)))
    for other in (b, b[::-1, ::-1]):
        for shift in range(-len(b), len(a) + 1):
            at = [x for x in range(len(a)) if 0 <= x - shift < len(b)]
            if len(at) >= need:
                best = max(best, np.mean([pearson(a[x], other[x - shift]) for x in at]))
    return 1 - best


def test_distance(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 4)
    motifs = make(13, 1)
    motifs[5] = motifs[2][::-1, ::-1][1:]
    table = D.pcc_distance(cells(spark, motifs)).collect()
    assert {(r.i, r.j) for r in table} == {(i, j) for i in motifs for j in motifs if i < j}
    for r in table:
        assert r.d == pytest.approx(brute_distance(motifs[r.i], motifs[r.j]), abs=1e-9)
        # the stated alignment gives the stated distance
        a, b = motifs[r.i], motifs[r.j]
        b = b[::-1, ::-1] if r.flipped else b
        at = [x for x in range(len(a)) if 0 <= x - r.offset < len(b)]
        assert 1 - np.mean([pearson(a[x], b[x - r.offset]) for x in at]) == pytest.approx(r.d, abs=1e-9)
    assert next(r.d for r in table if (r.i, r.j) == (2, 5)) == pytest.approx(0, abs=1e-9)
    two = D.pcc_distance_2(cells(spark, {k: motifs[k] for k in (0, 7)}), cells(spark, {k: motifs[k] for k in range(3, 12)}))
    got = {(r.i, r.j): r.d for r in two.collect()}
    assert len(got) == 18 and got[7, 3] == pytest.approx(brute_distance(motifs[7], motifs[3]), abs=1e-9)


def upgma(ids, d, limit):
    groups = {i: [i] for i in ids}
    mean = lambda x, y: np.mean([d[min(a, b), max(a, b)] for a in groups[x] for b in groups[y]])
    while len(groups) > 1:
        value, x, y = min((mean(x, y), x, y) for x in groups for y in groups if x < y)
        if value > limit:
            break
        groups[x] += groups.pop(y)
    return {m: k for k, g in groups.items() for m in g}


@pytest.mark.parametrize("seed", [1, 2])
def test_average_linkage(spark, seed):
    random.seed(seed)
    ids = list(range(24))
    at = {i: (random.random(), random.random()) for i in ids}
    d = {(i, j): float(np.hypot(at[i][0] - at[j][0], at[i][1] - at[j][1])) for i in ids for j in ids if i < j}
    table = spark.createDataFrame([(i, j, v) for (i, j), v in d.items()], "i long, j long, d double")
    got = L.cluster_motifs(spark.createDataFrame([(i,) for i in ids], "motif_id long"), table, 0.15)
    assert {r.motif_id: r.cluster for r in got.collect()} == upgma(ids, d, 0.3)


def test_two_clusters_and_singletons(spark):
    rows = [(0, 1, 0.04), (2, 3, 0.04)] + [(a, b, 0.5) for a in (0, 1) for b in (2, 3)] + [(a, 4, 0.9) for a in range(4)]
    ids = spark.createDataFrame([(i,) for i in range(5)], "motif_id long")
    clusters = L.cluster_motifs(ids, spark.createDataFrame(rows, "i long, j long, d double"), 0.05)
    assert {r.motif_id: r.cluster for r in clusters.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    single, grouped = W.split_singletons(clusters)
    assert [r.motif_id for r in single.collect()] == [4] and grouped.count() == 4


def test_consensus_of_shifted_and_flipped_copies(spark):
    base = make(1, 7, (8, 9))[0]
    motifs = {0: base, 1: base[::-1, ::-1], 2: base[1:]}
    table = cells(spark, motifs)
    clusters = spark.createDataFrame([(i, 9) for i in motifs], "motif_id long, cluster long")
    alignments = D.pcc_distance(table)
    center = L.medoids(clusters, alignments).first().medoid
    rows = sorted(L.consensus_profile(table, clusters, alignments).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(len(motifs[center])))
    for r in rows:
        assert (r.a, r.c, r.g, r.t) == pytest.approx(tuple(motifs[center][r.pos]), abs=1e-9)


def test_scan(spark, monkeypatch):
    monkeypatch.setattr(D, "SCAN_BLOCK", 2)
    monkeypatch.setattr(D, "SCAN_PIECE", 64)
    rng = np.random.default_rng(3)
    motifs = {i: rng.normal(size=(w, 4)) for i, w in enumerate((3, 4, 6, 6, 9))}
    texts = {g: "".join(rng.choice(list("ACGT"), n)) for g, n in ((1, 300), (2, 64), (3, 2), (4, 70))}
    texts[5] = "ACGTNNACGTNACGTACGTA" + "N" * 10
    seqs = spark.createDataFrame(list(texts.items()), "gene long, seq string")
    table = cells(spark, motifs)
    want = set()
    for m, w in motifs.items():
        limit = 0.6 * w.max(axis=1).sum()
        for turn, v in (("+", w), ("-", w[::-1, ::-1])):
            for g, s in texts.items():
                for i in range(len(s) - len(w) + 1):
                    if "N" not in s[i:i + len(w)] and sum(v[k]["ACGT".index(x)] for k, x in enumerate(s[i:i + len(w)])) >= limit - 1e-9:
                        want.add((g, m, i + 1, turn))
    got = D.scan_motifs(seqs, table, 0.6).collect()
    assert {(r.gene, r.motif_id, r.start, r.dir) for r in got} == want and len(got) == len(want)
    assert {tuple(r) for r in D.motif_genes(seqs, table, 0.6).collect()} == {(g, m) for g, m, _, _ in want}


def test_matrix_checks_and_trim(spark):
    bad = spark.createDataFrame([(0, 1, "0.5"), (0, 2, "nan"), (1, 1, "-"), (1, 2, "x"), (2, 1, "1")], "i long, j long, cell string")
    assert {(r.problem, r.i) for r in W.check_matrix(bad).collect()} == {("cell", 1), ("row", 2)}
    flat = [0.33, 0.17, 0.17, 0.33]
    motif = {0: np.array([flat, [0.97, 0.01, 0.01, 0.01], flat, [0.01, 0.97, 0.01, 0.01], flat])}
    assert sorted((r.pos, round(r.a, 2)) for r in W.trim(cells(spark, motif), 0.4).collect()) == [(0, 0.97), (1, 0.33), (2, 0.01)]
    word = spark.createDataFrame([(0, "AR"), (1, "#N")], "motif_id long, word string")
    assert sorted(map(tuple, W.pwm_from_text(word).collect())) == [(0, "AR", 0, 1.0, 0.0, 0.0, 0.0), (0, "AR", 1, 0.5, 0.0, 0.5, 0.0)]


def test_merge(spark):
    motifs = make(6, 11, (8, 9))
    motifs[4] = motifs[1].copy()
    genes = spark.createDataFrame([(g, int(g < 20)) for g in range(60)], "gene long, class int")
    hits = spark.createDataFrame([(1, g) for g in range(18)] + [(4, g) for g in range(25)], "motif_id long, gene long")
    out = L.merge_motifs(cells(spark, motifs), genes, lambda odds: hits, 0.05, True, 0.0)
    got = {(r.cluster, r.motif_id) for r in out.collect()}
    assert (1, 1) in got and (1, 4) not in got
    assert {c for c, _ in got} == {0, 1, 2, 3, 5}


def _made(spark, n, width=6):
    rng = random.Random(5)
    rows = []
    for m in range(n):
        for p in range(width):
            v = [rng.random() for _ in range(4)]
            rows.append((m, f"m{m}", p, *[x / sum(v) for x in v]))
    return spark.createDataFrame(rows, "motif_id long, name string, pos int, a double, c double, g double, t double")


def test_both_directions_from_one_pass_over_the_pairs(spark):
    d = D.pcc_distance(_made(spark, 7)).select("i", "j", "d")
    for made in (W.symmetric(d), W.assemble_matrix([d])):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
        assert sorted((r["i"], r["j"]) for r in made.collect()) == [(i, j) for i in range(7) for j in range(7) if i != j]


def test_blocks_of_motifs_stay_few(spark):
    ids = lambda n: spark.range(n).withColumnRenamed("id", "motif_id")
    assert [D._n_blocks(ids(n)) for n in (50, 2000, 10_000, 100_000)] == [1, 20, 25, 100]


def test_pairs_outside_clusters_are_not_needed(spark):
    cells, clusters = _made(spark, 9), spark.range(9).selectExpr("id AS motif_id", "if(id = 8, null, id % 2) AS cluster")
    every = D.pcc_distance(cells)
    inside = L.inside_clusters(every, clusters)
    assert inside.count() == 12
    told = lambda pairs: sorted(tuple(r) for r in L.consensus_profile(cells, clusters, pairs).selectExpr("cluster", "pos", "round(a, 9)", "members").collect())
    assert told(inside) == told(every)


def test_scan_builds_tables_one_block_at_a_time(spark, monkeypatch):
    rng = random.Random(2)
    seqs = spark.createDataFrame([(i, "".join(rng.choice("ACGTN") for _ in range(300))) for i in range(5)], "gene long, seq string")
    odds = W.probs_to_logodds(_made(spark, 12))
    sites = lambda: sorted(tuple(r) for r in D.scan_motifs(seqs, odds, 0.7).collect())
    want = sites()
    monkeypatch.setattr(D, "SCAN_BLOCK", 2)
    monkeypatch.setattr(D, "SCAN_KEPT", 3)
    monkeypatch.setattr(D, "SCAN_LETTERS", 500)
    assert sites() == want and want


def test_rounds_after_the_first_shuffle_merged_links_only(spark, monkeypatch):
    """Points whose gaps grow merge one by one: links that no round touched must last, and be written compressed, not as checkpoints."""
    at = np.cumsum([1.3**n for n in range(9)])
    d = {(i, j): float(at[j] - at[i]) for i in range(9) for j in range(9) if i < j}
    table = spark.createDataFrame([(i, j, v) for (i, j), v in d.items()], "i long, j long, d double")
    names, kept = [], L.written
    monkeypatch.setattr(L, "written", lambda df, name: names.append(name) or kept(df, name))
    got = L.cluster_motifs(spark.createDataFrame([(i,) for i in range(9)], "motif_id long"), table, 3.0)
    assert {r.motif_id: r.cluster for r in got.collect()} == upgma(range(9), d, 6.0)
    assert names.count("links") >= 4


def test_short_motifs_with_sites_everywhere_scan_in_bounded_memory():
    """256 motif strands of width 2 over 200,000 letters are 410 MB of scores at once."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(5)
    motifs = [(i, rng.normal(size=8) * 0.01 + 1, 0.5) for i in range(D.SCAN_BLOCK)]
    text = "".join(rng.choice(list("ACGT"), 200_000))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([0]), pa.array([text])], names=["gene", "at", "text"])
    tracemalloc.start()
    pairs = [tuple(r) for out in D._scan(SimpleNamespace(value=motifs), 10**6, False, iter([batch])) for r in zip(*(c.to_pylist() for c in out.columns))]
    sites = sum(out.num_rows for out in D._scan(SimpleNamespace(value=motifs[:3]), 10**6, True, iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(set(pairs)) == [(7, i) for i in range(D.SCAN_BLOCK)]
    assert sites == 3 * 2 * (len(text) - 1)
    assert peak < 250e6


def test_pairs_take_the_numbers_of_blocks_and_no_copies_of_motifs(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    monkeypatch.setattr(D, "HELD_CELLS", 4 * 8 * 4)  # four motifs a set
    for widths in ((8, 9), (5, 9)):
        motifs = make(11, 4, widths)
        table, plain = D.pcc_distance(cells(spark, motifs)), D.pcc_distance(cells(spark, motifs), aligned=False)
        want = {(i, j): brute_distance(motifs[i], motifs[j]) for i in motifs for j in motifs if i < j}
        for rows in (table.collect(), plain.collect()):
            assert len(rows) == 55 and {(r.i, r.j): r.d for r in rows} == pytest.approx(want, abs=1e-9)
        for r in table.collect():
            b = motifs[r.j][::-1, ::-1] if r.flipped else motifs[r.j]
            at = [x for x in range(len(motifs[r.i])) if 0 <= x - r.offset < len(b)]
            assert 1 - np.mean([pearson(motifs[r.i][x], b[x - r.offset]) for x in at]) == pytest.approx(r.d, abs=1e-9)
        two = D.pcc_distance_2(cells(spark, {k: motifs[k] for k in range(5)}), cells(spark, {k: motifs[k] for k in range(2, 11)}), aligned=False)
        assert {(r.i, r.j): r.d for r in two.collect()} == pytest.approx(
            {(i, j): brute_distance(motifs[i], motifs[j]) for i in range(5) for j in range(2, 11)}, abs=1e-9)
    # Pairs are many more than their numbers: a join must not take them for the small side.
    families = spark.range(11).selectExpr("id AS j", "'f' AS family")
    plan = W.family_average(W.symmetric(plain), families)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "SortMergeJoin" not in plan and "p#" not in plan


def test_pairs_inside_clusters_alone_are_computed(spark):
    table = _made(spark, 9)
    told = lambda rows: sorted((r.i, r.j, round(r.d, 9), r.offset, r.flipped) for r in rows.collect())
    for made in ("if(id = 8, null, id % 2)", "explode(array(id % 2, id % 3))"):
        clusters = spark.range(9).selectExpr("id AS motif_id", f"{made} AS cluster")
        assert told(L.pairs_inside(table, clusters)) == told(L.inside_clusters(D.pcc_distance(table), clusters))


def test_old_links_are_emptied(spark, monkeypatch):
    tables, kept = [], L.written
    monkeypatch.setattr(L, "written", lambda df, name: tables.append((name, kept(df, name))) or tables[-1][1])
    rng = np.random.default_rng(1)
    rows = [(i, j, float(rng.uniform(0, 2))) for i in range(9) for j in range(i + 1, 9)]
    L.cluster_motifs(spark.range(9).withColumnRenamed("id", "motif_id"), spark.createDataFrame(rows, "i long, j long, d double"), 3.0)
    links = [df for name, df in tables if name == "links"]
    assert len(links) > 2 and all(spark.read.parquet(df.inputFiles()[0].rsplit("/", 1)[0]).isEmpty() for df in links[:-1])
