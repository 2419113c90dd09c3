import random

import numpy as np
from pyspark.sql import functions as F

from kmerlake.llm.topk import Best, distances, top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, wanted):
    sound = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, _ in rows
             if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in sound), default=0)
    sound = [(i, v + [0] * (width - len(v))) for i, v in sound]
    out = []
    for n, (i, v) in enumerate(sound):
        if wanted(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(sound) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], "own") for i in range(300)]
    rows += [(300 + i, [0.5] * 6, "own") for i in range(150)]  # ties
    rows += [rows[20], rows[20], (20, [1.0, 2.0], "own"), (7, [], "own"), (8, None, "own"), (9, [1.0, None], "own"),
             (10, [float("nan")], "own"), (11, [float("inf")], "own"), (None, [1.0], "own"), (600, [1000.0] * 6, "own")]
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0, k=7, n_pivots=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7, lambda i: i % 20 == 0)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [0.5, 0.5], "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in top_k(docs, F.col("id") % 20 == 0).collect()] == [(0, 1, 1, 2048)]
    assert top_k(docs.limit(0), F.col("id") % 20 == 0).count() == 0
    assert top_k(docs.where("vec_id = 1"), F.col("id") % 20 == 0).count() == 0


def test_stops_early_and_stays_exact():
    """Clustered vectors: bounds end the search before all candidates are evaluated."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 100, (10, 16))
    v = np.floor(centres[rng.integers(0, 10, 5000)] + rng.normal(0, 1, (5000, 16))).astype(np.int64)
    pivots, ids = v[:32], np.arange(5000)
    d = distances(v, pivots)
    best = Best(ids[:20], v[:20], d[:20], 5)
    for start in range(0, 5000, 1000):
        part = slice(start, start + 1000)
        best.offer(ids[part], v[part], d[part], np.ones(1000, np.int64))
    assert best.evaluated < 20 * 5000 / 2
    for i in range(20):
        scores = v @ v[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
        assert best.top[i][1].tolist() == order and best.top[i][0].tolist() == scores[order].tolist()


def test_large_numbers_stay_exact(spark):
    rows = [(0, [2.0**24, 1.0], ""), (1, [2.0**24, 1.0], ""), (2, [2.0**24, -1.0], "")]
    got = [(r["vec_id"], r["score"]) for r in top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2**60 + 4096), (2, 2**60 - 4096)]
