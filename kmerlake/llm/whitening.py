"""Embedding whitening by FEAST: contour integration finds the leading components of the covariance.

Entries become integers, floor(scale * c) + shift. Three passes of small sums over the tasks' Arrow batches give the number of
vectors and the exact sums of each dimension, the centred covariance, and the covariance of the whitened vectors as a check;
a fourth pass writes the result. The driver holds one matrix of the vectors' dimension, never vectors. Its largest eigenpairs
come from ``feast``: circles around eigenvalue intervals, Rayleigh-Ritz, and inertia counts that prove none is missed.

Rows take no part if their vector is null or empty, or holds null, non-finite or absurd entries (scale * |c| of 2^52 and more);
of several lengths only the commonest does (the longest of equally common ones). Repeated rows and rows without an id count and
come out like any other. Components with an eigenvalue of less than 1e-12 of the largest have no direction to scale and are left
out: a table of equal vectors, of one vector, or of none gives no rows.
"""

from __future__ import annotations

from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerlake.llm import feast

_LARGEST = 2.0**52
_SAFE = 2**62
_HALF = 26
_LEAST = 1e-12


def sound_vectors(vectors: DataFrame, id_column: str, vector: str, scale: float, shift: int) -> DataFrame:
    """(id, x): the integers of every vector that takes part, whatever its length."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) * scale < _LARGEST), F.lit(False)))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col(f"`{id_column}`").alias("id"), F.transform(v, lambda x: F.floor(x * scale) + F.lit(shift).cast("long")).alias("x"))


def _matrix(lists) -> np.ndarray:
    """Rows of one length."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _sums(batches):
    """Rows and sums of each dimension, by length; sums are put together from halves that cannot overflow."""
    held: dict[int, list] = {}
    for batch in batches:
        lengths = pa.compute.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False)
        for length in np.unique(lengths):
            x = _matrix(batch.column("x").filter(pa.array(lengths == length)))
            low, high = x & ((1 << _HALF) - 1), x >> _HALF
            sums = [(int(h) << _HALF) + int(k) for h, k in zip(high.sum(0), low.sum(0))]
            old = held.get(int(length), [0, [0] * int(length)])
            held[int(length)] = [old[0] + len(x), [a + b for a, b in zip(old[1], sums)]]
    rows = [(length, i, n, Decimal(s)) for length, (n, sums) in held.items() for i, s in enumerate(sums)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
    columns = zip(*rows) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["length", "dim", "n", "s"])


class Centre:
    """Exact deviations n * x - S of integer vectors from their mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """64-bit numbers where they suffice, else Python's."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(abs(s) for s in self.sums)
        if most < _SAFE:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def square(self, x: np.ndarray) -> list[Decimal | None]:
        """Sum of squared deviations; null beyond 38 digits."""
        d = self.deviations(x)
        if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= _SAFE:
            d = d.astype(object)
        sums = (d * d).sum(axis=1)
        return [Decimal(int(s)) if s < 10**38 else None for s in sums]


def _products(centre: Centre, directions: np.ndarray | None, batches):
    """Sums of products of two coordinates, of the centred vectors or of their projections, and of single ones (i = -1)."""
    size = len(centre.sums) if directions is None else directions.shape[1]
    gram, single = np.zeros((size, size)), np.zeros(size)
    for batch in batches:
        if batch.num_rows:
            c = centre.centred(_matrix(batch.column("x")))
            c = c if directions is None else c @ directions
            gram += c.T @ c
            single += c.sum(0)
    i, j = np.triu_indices(size)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(i, np.full(size, -1)), pa.int32()), pa.array(np.append(j, np.arange(size)), pa.int32()),
         pa.array(np.append(gram[i, j], single))], names=["i", "j", "v"])


def covariance(rows: DataFrame, centre: Centre, directions: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors, or of their projections on the columns of ``directions``."""
    size = len(centre.sums) if directions is None else directions.shape[1]
    parts = rows.mapInArrow(partial(_products, centre, directions), "i int, j int, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    i, j, v = (found[c].to_numpy() for c in ("i", "j", "v"))
    mean = np.zeros(size)
    mean[j[i < 0]] = v[i < 0] / centre.n
    gram = np.zeros((size, size))
    gram[i[i >= 0], j[i >= 0]] = v[i >= 0] / centre.n
    gram = gram + np.triu(gram, 1).T
    return gram - np.outer(mean, mean)


def _whitened(centre: Centre, directions: np.ndarray, kind: pa.DataType, batches):
    many = directions.shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("x"))
        projected = centre.centred(x) @ directions
        rows = np.repeat(np.arange(len(x)), many)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(rows)).cast(kind), pa.array(np.tile(np.arange(1, many + 1), len(x)), pa.int32()),
             pa.array(centre.square(x), pa.decimal128(38, 0)).take(pa.array(rows)), pa.array(projected.ravel())],
            names=["id", "component", "deviation", "whitened"])


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 8, scale: float = 1024.0, shift: int = 100_000
) -> DataFrame:
    """One row for each vector and component: the id, ``component`` (from 1, falling eigenvalue), ``n``, ``deviation`` (decimal),
    ``whitened``, ``explained`` (share of the trace) and ``identity_error`` (of the whitened vectors' covariance)."""
    every = sound_vectors(vectors, id_column, vector, scale, shift)
    sums = every.mapInArrow(_sums, "length int, dim int, n long, s decimal(38,0)").groupBy("length", "dim").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    commonest = sums.groupBy("length").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    kind = every.schema["id"].dataType
    head = T.StructType([
        T.StructField("id", kind), T.StructField("component", T.IntegerType()), T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType())])
    names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    nothing = every.sparkSession.createDataFrame([], head)
    if commonest is None:
        return nothing.select(
            F.col("id").alias(id_column), "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened",
            F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).select(*names)
    length, n = commonest["length"], commonest["n"]
    of_dim = {r["dim"]: int(r["s"]) for r in sums.where(F.col("length") == length).collect()}
    rows = every.where(F.size("x") == length)
    centre = Centre(n, [of_dim[i] for i in range(length)])
    matrix = covariance(rows, centre)
    values, axes = feast.largest(matrix, components)
    kept = values > _LEAST * max(float(values.max(initial=0.0)), 1e-300)
    values, axes = values[kept], axes[:, kept]
    directions = axes / np.sqrt(values)
    if len(values):
        checked = covariance(rows, centre, directions)
        identity_error = float(np.abs(checked - np.eye(len(values))).max())
        arrow = rows.sparkSession.createDataFrame([], T.StructType([T.StructField("id", kind)])).toArrow().schema.field("id").type
        found = rows.mapInArrow(partial(_whitened, centre, directions, arrow), head)
    else:
        identity_error, found = 0.0, nothing
    shares = [float(v) for v in values / np.trace(matrix)] if len(values) else [0.0]
    return found.select(
        F.col("id").alias(id_column), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("component")).alias("explained"), F.lit(identity_error).alias("identity_error"))
