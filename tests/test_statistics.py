"""Exact tests, Welch, adjustment and metrics against hand-worked or brute-force values."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kmerlake.functions import exact
from kmerlake.functions.welch import t_two_tailed
from kmerlake.operators import enrichment as E
from kmerlake.operators import metrics as M


def brute(a, m, b, n):
    drawn = a + b
    pmf = {x: Fraction(math.comb(m, x) * math.comb(n, drawn - x), math.comb(m + n, drawn))
           for x in range(max(0, drawn - n), min(m, drawn) + 1)}
    return float(sum(v for x, v in pmf.items() if x >= a)), float(
        sum(v for v in pmf.values() if v <= pmf[a] * Fraction(10000001, 10000000)))


def test_fisher_against_exact_fractions(spark):
    random.seed(1)
    rows = [(3, 4, 1, 4), (0, 5, 2, 7), (5, 5, 7, 7), (0, 5, 0, 7), (295, 341, 25, 58), (500, 571, 3300, 3409), (571, 571, 3000, 3409)]
    for _ in range(150):
        m, n = random.randint(1, 60), random.randint(1, 80)
        rows.append((random.randint(0, m), m, random.randint(0, n), n))
    cells = [F.col(c) for c in "ambn"]
    out = spark.createDataFrame(rows, "a long, m long, b long, n long").select(
        "*", exact.fisher_greater(*cells).alias("one"), exact.fisher_two_sided(*cells).alias("two")).collect()
    for r in out:
        one, two = brute(r.a, r.m, r.b, r.n)
        assert r.one == pytest.approx(one, rel=1e-10)
        assert r.two == pytest.approx(two, rel=1e-10)


def test_known_tables(spark):
    args = [F.lit(v) for v in (3, 4, 1, 4)]
    row = spark.range(1).select(
        exact.fisher_greater(*args).alias("one"), exact.fisher_two_sided(*args).alias("two"),
        exact.odds_ratio(*args).alias("odds"), exact.odds_ratio(*[F.lit(v) for v in (3, 4, 0, 4)]).alias("inf"),
        exact.odds_ratio(*[F.lit(v) for v in (0, 4, 0, 4)]).alias("nan"),
        exact.fisher_greater(F.lit(5), F.lit(4), F.lit(0), F.lit(4)).alias("bad"),
        exact.fisher_balanced(F.lit(3), F.lit(1), F.lit(9)).alias("half")).first()
    assert row.one == pytest.approx(17 / 70)
    assert row.two == pytest.approx(34 / 70)
    assert row.odds == 9 and math.isinf(row.inf) and math.isnan(row.nan) and row.bad == 1
    assert row.half == pytest.approx(17 / 70)


def test_fisher_at_a_billion_genes(spark):
    row = spark.range(1).select(exact.fisher_greater(
        F.lit(100_010_000), F.lit(200_000_000), F.lit(400_000_000), F.lit(800_000_000)).alias("p")).first()
    z = (100_010_000 - 500_010_000 * 0.2) / math.sqrt(500_010_000 * 0.2 * 0.8 * 0.5)
    assert row.p == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-3)


def test_welch(spark):
    rows = [(1.7320508, 4.4117647, 0.151), (2.0, 10.0, 0.07339), (12.706, 1.0, 0.05), (3.169, 10.0, 0.01)]
    out = spark.createDataFrame(rows, "t double, df double, p double").select("p", t_two_tailed(F.col("t"), F.col("df")).alias("q"))
    for r in out.collect():
        assert r.q == pytest.approx(r.p, abs=1e-3)


def test_welch_large_df_is_normal(spark):
    for t in (1.96, 2.999, 3.001, 6.0):
        p = spark.range(1).select(t_two_tailed(F.lit(t), F.lit(1e9)).alias("p")).first().p
        assert p == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-5)


def test_bh_with_ties_and_families(spark):
    p = [0.01, 0.02, 0.02, 0.04, 0.5]
    rows = [(f, f"k{i}", v) for f in ("x", "y") for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "family string, token string, pvalue double")
    got = {(r.family, r.token): r.padj for r in E.bh_adjust(df, ["family"]).collect()}
    want = [1 / 30, 1 / 30, 1 / 30, 0.05, 0.5]
    for f in ("x", "y"):
        assert [got[f, f"k{i}"] for i in range(5)] == pytest.approx(want)


def test_bh_against_plain_rule(spark):
    random.seed(3)
    p = [round(random.random() ** 3, 3) + 1e-6 for _ in range(400)] + [1.0] * 200
    df = spark.createDataFrame([(f"k{i:03}", v) for i, v in enumerate(p)], "token string, pvalue double")
    got = {r.token: r.padj for r in E.bh_adjust(df).collect()}
    order = sorted(range(len(p)), key=lambda i: p[i])
    least = 1.0
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        least = min(least, p[i] * len(p) / rank)
        assert got[f"k{i:03}"] == pytest.approx(least)


def test_metrics(spark):
    random.seed(4)
    rows = [(random.randint(0, 1), random.choice([0.1, 0.2, 0.5, 0.9, -3.0, 70.5]) + random.randint(0, 3) / 7) for _ in range(300)]
    df = spark.createDataFrame([(c, s, int(s >= 0.5)) for c, s in rows], "class int, score double, predicted int")
    pos, neg = [s for c, s in rows if c], [s for c, s in rows if not c]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert M.auc_roc(df).first().auc == pytest.approx(wins)
    for r in M.pr_points(df).collect():
        tp = sum(c and s >= r.score for c, s in rows)
        fp = sum((not c) and s >= r.score for c, s in rows)
        assert (r.tp, r.fp) == (tp, fp)
        assert r.precision == pytest.approx(tp / (tp + fp)) and r.recall == pytest.approx(tp / len(pos))
    none = spark.createDataFrame([(0, 1), (1, 0)], "class int, predicted int")
    assert M.confusion(none).first().f1 is None and M.accuracy_f1(none).first().f1 == 0
