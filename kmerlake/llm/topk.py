"""Exact top-k search by inner product with a pivot table.

Components become integers, floor(scale * x). A bounded sample of vectors are the pivots; every
vector's distances to all of them are computed once. For a query q and a candidate x the largest
|d(q, p) - d(x, p)| over the pivots p is a lower bound of d(q, x), and as
2 q.x = |q|^2 + |x|^2 - d(q, x)^2 it bounds the score from above, as |q||x| does. Candidates are
evaluated in the order of their bounds until the next bound is below the k-th best score, so the
result is exact whatever the pivots are. A block of queries is evaluated together, in the order of
the highest bound that any of them gives a candidate, and ends when that is below the k-th best of
all of them. Bounds only save evaluations.

Queries are cut into groups and candidates into shards of bounded size; a task streams one shard
past one group in Arrow batches and keeps k rows for each query.

Rows whose id or vector is null, or whose vector is empty or holds null or non-finite components,
take no part. Shorter vectors count as padded with zeros. Equal rows are held once with their
number and come out as often; a query leaves out one copy of its own row. Scores that do not fit
64 bits are an error of the task.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.llm.common import stored

GROUP, SHARD = 4096, 1_000_000
_ROWS = 64  # queries whose bounds are held at once
_CHUNK = 256  # candidates evaluated before the next look at the bounds
_SLACK = 1e-5  # relative, far above the rounding of single-precision distances


def quantised(vectors: DataFrame, id_column: str, vector: str, scale: float) -> DataFrame:
    """Distinct (id, v) with ``copies``; v holds integers."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(id_column).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(sound).select(
        F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(scale))).alias("v"))
    return rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))


def _matrix(lists: pa.Array) -> np.ndarray:
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """A number type in which all sums of a product of integer rows are exact: its sums stay below |a||b|."""
    most = math.sqrt(float((a.astype(np.float64) ** 2).sum(1).max(initial=0)) * float((b.astype(np.float64) ** 2).sum(1).max(initial=0)))
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else object


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, pivots = v.astype(np.float64), pivots.astype(np.float64)
    square = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def _with_distances(pivots: np.ndarray, batches):
    for batch in batches:
        v = _matrix(batch.column("v"))
        d = distances(v, pivots) if len(v) else np.zeros((0, len(pivots)), np.float32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("v"), batch.column("copies"), pa.array(list(d), pa.list_(pa.float32()))],
            names=["id", "v", "copies", "d"])


class Best:
    """The k best candidates so far of each query of a group."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, d: np.ndarray, k: int):
        self.ids, self.v, self.d, self.k = ids, v, d, k
        self.norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        self.top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.evaluated = 0

    def floor_of(self, i: int) -> float:
        """Score that a new candidate must reach."""
        scores = self.top[i][0]
        return float(scores[-1]) if len(scores) == self.k else -math.inf

    def _bounds(self, rows: slice, d: np.ndarray, norm: np.ndarray) -> np.ndarray:
        least = np.zeros((rows.stop - rows.start, len(d)), np.float32)
        for p in range(d.shape[1]):
            np.maximum(least, np.abs(self.d[rows, p][:, None] - d[:, p][None, :]), out=least)
        mine, theirs = self.norm[rows].astype(np.float32)[:, None], norm.astype(np.float32)[None, :]
        size = mine**2 + theirs**2
        least -= _SLACK * np.sqrt(size)
        np.maximum(least, 0, out=least)
        return np.minimum((size - least**2) / 2, mine * theirs) + (_SLACK * size + 0.5)

    def offer(self, ids: np.ndarray, v: np.ndarray, d: np.ndarray, copies: np.ndarray) -> None:
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        kind = _exact_kind(self.v, v)
        queries, candidates = self.v.astype(kind), v.astype(kind)
        for start in range(0, len(self.ids), _ROWS):
            rows = slice(start, min(start + _ROWS, len(self.ids)))
            bounds = self._bounds(rows, d, norm)
            order = np.argsort(-bounds.max(axis=0), kind="stable")
            bounds, ordered = bounds[:, order], candidates[order]
            floors = np.array([self.floor_of(i) for i in range(rows.start, rows.stop)])
            for at in range(0, len(order), _CHUNK):
                if bounds[:, at].max() < floors.min():
                    break  # no later candidate reaches any of these queries
                open_ = np.flatnonzero((bounds[:, at : at + _CHUNK] >= floors[:, None]).any(axis=1))
                scores = queries[rows][open_] @ ordered[at : at + _CHUNK].T
                self.evaluated += scores.size
                reached = scores >= floors[open_][:, None]
                for n in np.flatnonzero(reached.any(axis=1)):
                    i = rows.start + open_[n]
                    self._keep(i, scores[n], np.flatnonzero(reached[n]), order[at : at + _CHUNK], ids, v, copies)
                    floors[open_[n]] = self.floor_of(i)

    def _keep(self, i: int, scores: np.ndarray, reach: np.ndarray, part: np.ndarray, ids: np.ndarray, v: np.ndarray, copies: np.ndarray) -> None:
        """Merge those of the candidates ``part`` that reach the k-th best into the best of query ``i``."""
        if len(reach) > 4 * self.k:  # below the (k + 1)-th of this part nothing can stay: one may be the query's own row
            least = np.partition(scores[reach], len(reach) - self.k - 1)[len(reach) - self.k - 1]
            reach = reach[scores[reach] >= least]
        rows = part[reach]
        times = copies[rows].copy()
        for n in np.flatnonzero(ids[rows] == self.ids[i]):
            times[n] -= (v[rows[n]] == self.v[i]).all()
        times = np.minimum(times, self.k)
        every = np.concatenate([self.top[i][0], np.repeat(scores[reach].astype(np.int64), times)])
        found = np.concatenate([self.top[i][1], np.repeat(ids[rows], times)])
        order = np.lexsort((found, -every))[: self.k]
        self.top[i] = every[order], found[order]


def _search_groups(k: int, batches):
    """Rows arrive by (part, kind): the queries of a part (kind 0) and then its candidates."""
    part, held, best = None, [], None

    def results():
        for i, (scores, found) in enumerate(best.top):
            n = len(scores)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, best.ids[i])), pa.array(np.full(n, best.uids[i])), pa.array(np.full(n, best.copies[i])),
                 pa.array(found), pa.array(scores)], names=["query_id", "uid", "times", "vec_id", "score"])

    def begin():
        ids, uids, copies, v, d = (np.concatenate([h[n] for h in held]) for n in range(5))
        made = Best(ids, v, d, k)
        made.uids, made.copies = uids, copies
        return made

    for batch in batches:
        parts, kinds = (batch.column(c).to_numpy() for c in ("part", "kind"))
        cuts = np.flatnonzero(np.diff(parts) | np.diff(kinds)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(parts)]):
            if start == stop:
                continue
            piece = batch.slice(start, stop - start)
            if parts[start] != part:
                if best is not None:
                    yield from results()
                part, held, best = parts[start], [], None
            columns = [piece.column(c).to_numpy() for c in ("id", "uid", "copies")]
            v, d = _matrix(piece.column("v")), _matrix(piece.column("d"))
            if kinds[start] == 0:
                held.append([*columns, v, d])
            elif held:
                best = best or begin()
                best.offer(columns[0], v, d, columns[2])
    if best is not None:
        yield from results()


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, n_pivots: int = 32, id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of each query, ties to the smaller id.

    ``is_query``: a condition on ``id``. ``n_pivots`` vectors (smallest hash) are brought to the driver.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_column, vector, scale), "topk-rows")
    sizes = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if(is_query)).first()
    n, width, n_queries = sizes[0], sizes[1] or 1, sizes[2]
    pad = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    rows = rows.select("id", pad.alias("v"), "copies")
    chosen = rows.orderBy(F.xxhash64("id", "v"), "id").limit(n_pivots).select("v").collect()
    pivots = np.array([r["v"] for r in chosen], np.float64).reshape(len(chosen), width)
    ready = stored(rows.mapInArrow(partial(_with_distances, pivots), "id long, v array<long>, copies long, d array<float>"), "topk-pivots")
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(math.ceil(n_queries / GROUP), min(n_queries, tasks), 1)
    shards = max(math.ceil(n / SHARD), 1)
    uid = F.xxhash64("id", "v")
    ready = ready.withColumn("uid", uid)
    place = lambda g, s: (g * F.lit(shards) + s).cast("long")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = ready.where(is_query).withColumn("_s", every(shards)).select(
        place(F.pmod("uid", F.lit(groups)), F.col("_s")).alias("part"), F.lit(0).alias("kind"), "id", "uid", "copies", "v", "d")
    candidates = ready.withColumn("_g", every(groups)).select(
        place(F.col("_g"), F.pmod(F.shiftright("uid", 20), F.lit(shards))).alias("part"), F.lit(1).alias("kind"), "id", "uid", "copies", "v", "d")
    dealt = queries.union(candidates).repartitionByRange(min(groups * shards, 100_000), "part").sortWithinPartitions("part", "kind")
    found = dealt.mapInArrow(partial(_search_groups, k), "query_id long, uid long, times long, vec_id long, score long")
    order = Window.partitionBy("query_id", "uid").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", "rank", "vec_id", "score")
