"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a pair of joins and sums over the links, written to the shared folder; the driver
sees two numbers of a round. The least-neighbour tables are written before they are joined, so
that a hub with most of the links is a skewed join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least node around it."""
    both = links.union(links.select("b", "a")).toDF("a", "b")
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "star-least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; ``a`` is the larger end."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("m")), "star-least")
    moved = links.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the least node reachable.

    ``links``: two columns of one ordered type, in any direction, repeats and loops allowed.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    state = stored(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "star-links")
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark[0] == 0 or mark == seen:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                state.select("b", "b").distinct())
        seen = mark
        state = stored(_small_star(stored(_large_star(state), "star-large")), "star-links")
