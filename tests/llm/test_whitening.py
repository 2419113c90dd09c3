import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.llm import feast
from kmerlake.llm.common import table
from kmerlake.llm.queries import QUERIES
from kmerlake.llm.whitening import Centre, whiten

SF = "/root/testdata/sf0.001"


def noise(rows, columns, seed=0):
    return np.random.default_rng(seed).standard_normal((rows, columns))


@pytest.mark.parametrize("matrix", [
    noise(300, 40).T @ noise(300, 40), np.eye(30) * 3 + 1e-4 * (noise(30, 30) + noise(30, 30).T), np.eye(9), np.array([[4.0]]),
    noise(2, 20).T @ noise(2, 20), np.diag([2e5, *np.linspace(16300, 15900, 50)]) + 1e-3 * (noise(51, 51) + noise(51, 51).T),
    np.diag([7.0, *[1 + 1e-9 * i for i in range(12)], *[0.5] * 20]), np.diag(1.0 / np.arange(1, 40) ** 6), np.array([[0.0, 1.0], [1.0, 0.0]]), np.diag([5.0, 5, 5, 5, 4, 4, 3, 2, 1, 1, 1, 1, 1])])
def test_feast_equals_full_solution(matrix):
    want = np.linalg.eigvalsh(matrix)[::-1][:8]
    values, vectors = feast.largest(matrix, 8)
    scale = max(abs(want[0]), 1e-9)
    assert np.abs(values - want).max() < 1e-12 * scale
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_inertia_counts():
    matrix = noise(25, 25) + noise(25, 25).T
    values = np.linalg.eigvalsh(matrix)
    for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.0]:
        assert feast.count_above(matrix, shift) == (values > shift).sum()
    assert feast.count_above(np.zeros((4, 4)), 0.0) == 0


def test_an_interval_that_hides_a_value_is_an_error():
    with pytest.raises(ArithmeticError):
        feast.pairs_inside(np.diag([1.0, 2.0, 3.0]), 1.5, 3.5, 3)


def check(rows, vectors, ids):
    """Rows against a full decomposition; ``vectors`` are those that take part."""
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    c = (x * n - sums) / n
    cov = c.T @ c / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    got = {}
    for r in rows:
        got.setdefault(r["component"], []).append(r)
    assert sorted(got) == list(range(1, 1 + int((values > 1e-12 * values[0]).sum())))
    for k, found in got.items():
        assert sorted((r["vec_id"] is not None, r["vec_id"]) for r in found) == sorted((i is not None, i) for i in ids)
        by_id = {r["vec_id"]: r["whitened"] for r in found}
        want = dict(zip(ids, c @ axes[:, k - 1] / np.sqrt(values[k - 1])))
        sign = np.sign(sum(by_id[i] * want[i] for i in want))
        assert max(abs(sign * by_id[i] - want[i]) for i in want) < 1e-8
        assert all(r["n"] == n and abs(r["explained"] / (values[k - 1] / np.trace(cov)) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in found)
        deviation = {i: int(((xx.astype(object) * n - sums.astype(object)) ** 2).sum()) for i, xx in zip(ids, x)}
        assert {r["vec_id"]: int(r["deviation"]) for r in found} == deviation


def test_registered_query(spark):
    source = table(spark, SF, "embeddings").collect()
    rows = QUERIES["op11_whitening"](spark, SF)
    assert dict(rows.dtypes)["deviation"] == "bigint"
    check(rows.collect(), [r["embedding"] for r in source], [r["vec_id"] for r in source])


def test_rows_that_take_no_part(spark):
    good = noise(40, 3).tolist()
    ids = [*range(38), None, 39]
    rows = list(zip(ids, good))
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]),
             (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "n": F.lit(1), "x": F.lit(2)})
    check(whiten(df).collect(), good, ids)


def test_few_or_equal_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        out = whiten(spark.createDataFrame(rows, schema))
        assert out.collect() == [] and out.columns[:2] == ["vec_id", "component"]
    pair = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 2.0]), (1, [3.0, 2.0])], schema)).collect()
    assert len(pair) == 3 and {r["component"] for r in pair} == {1}


def test_large_numbers_stay_exact():
    n, sums = 10**9, [10**9 * 100_003 + 7, -5]
    x = np.array([[2**50, 3], [100_000, 0]])
    want = [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums)) for row in x]
    centre = Centre(n, sums)
    assert [None if s is None else int(s) for s in centre.square(x)] == [w if w < 10**38 else None for w in want]
    assert abs(centre.centred(x)[1, 0] - (100_000 * n - sums[0]) / n) < 1e-12
