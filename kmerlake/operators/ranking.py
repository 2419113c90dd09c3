"""Ranks and running totals over large groups without sorting a group in one task.

Rows carry a bucket that rises with the sort key. Inside a bucket a window gives the running
value; the buckets before it are reduced to one row each and carried in. A hot group is thus
split over its buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = "_bucket"


def log_probability_bucket(ln_p: Column) -> Column:
    """Rising bucket for the logarithms of values in [0, 1]: even steps of the value, logarithmic near 0."""
    return F.when(ln_p > math.log(0.01), F.floor(F.exp(ln_p) * 256)).otherwise(F.floor(ln_p * (8 / math.log(2)))).cast("long")


def score_bucket(score: Column) -> Column:
    """Rising bucket for any real score: 256 steps a unit up to ±64, then 4096 steps for each doubling."""
    size = F.abs(score)
    far = 64 * 256 + F.log2(F.greatest(size, F.lit(64.0)) / 64) * 4096
    return F.floor(F.when(size <= 64, score * 256).otherwise(F.signum(score) * far)).cast("long")


def hash_key(*parts: Column) -> Column:
    """Portable shuffle order: md5 of the parts joined by ``:``."""
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("long")


def running(
    df: DataFrame, by: list[str], order: list[str], op: str, column: str, out: str, descending: bool = False
) -> DataFrame:
    """Add the running ``sum`` or ``min`` of ``column`` up to and including each row."""
    fn = {"sum": F.sum, "min": F.min}[op]
    direction = (lambda c: F.col(c).desc()) if descending else F.col
    group = [F.col(c) for c in by] or [F.lit(0)]
    parts = df.groupBy(*by, BUCKET).agg(fn(column).alias("_part"))
    before = Window.partitionBy(*group).orderBy(direction(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*by, BUCKET, fn("_part").over(before).alias("_carried"))
    inside = Window.partitionBy(*by, BUCKET).orderBy(*[direction(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    joined = df.withColumn("_inside", fn(column).over(inside)).join(carried, [*by, BUCKET])
    value = (
        F.coalesce("_carried", F.lit(0)) + F.col("_inside") if op == "sum" else F.least("_carried", "_inside"))
    return joined.withColumn(out, value).drop("_inside", "_carried")


def rank_by_hash(df: DataFrame, by: list[str], key: Column, tie: str) -> DataFrame:
    """Add ``rank`` (from 1) in the order of an md5 key inside each group."""
    keyed = df.withColumn("_key", key).withColumn(BUCKET, hash_bucket(F.col("_key"))).withColumn("_one", F.lit(1))
    return running(keyed, by, ["_key", tie], "sum", "_one", "rank").drop("_key", "_one", BUCKET)


def attach_one_row(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Append the columns of a frame that an ungrouped aggregate bounds to one row."""
    return df.join(F.broadcast(facts))
