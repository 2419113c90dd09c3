"""Temperature mixing of sources, in DataFrame functions only.

Sources have token shares; a weight is the share raised to an exponent, normalised. The exponent
is bisected on a grid: the largest in [0, 1] whose weights reach a target entropy, and not below
the smallest whose weights repeat no source more than a limit (the limit wins). A source's budget
is its weight of all tokens to draw. Its documents lie in blocks of about ``block_tokens`` by the
hash of their id; each block gets its share of the budget and spends it in whole passes over a
permutation of its documents, new in each pass, and the nearest part of a last pass. No window
spans more than a block.

Tokens are words between ASCII white space. Null texts have none. Null sources form one source.
A source without tokens has no weight; its rows pass once, as they cost nothing. Rows with one
``doc_id`` (or null) fall into one block and are drawn each for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.llm.common import stored, without

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 10_000
NEW = ["n_tokens", "epoch", "block", "slot"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_totals(rows: DataFrame) -> DataFrame:
    """Tokens of each source, and its natural share among all tokens."""
    return rows.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"))


def _shares(totals: DataFrame) -> DataFrame:
    whole = totals.agg(F.sum("tokens").alias("whole"))  # one row
    return totals.where("tokens > 0").join(F.broadcast(whole)).withColumn("share", F.col("tokens").cast("double") / F.col("whole"))


def weigh(shares: DataFrame, exponent: float) -> DataFrame:
    """Append ``weight``: the share to the exponent, normalised."""
    raised = shares.withColumn("_raised", F.pow("share", F.lit(exponent)))
    norm = raised.agg(F.sum("_raised").alias("_norm"))  # one row
    return raised.join(F.broadcast(norm)).withColumn("weight", F.col("_raised") / F.col("_norm")).drop("_raised", "_norm")


def _measure(shares: DataFrame, exponent: float) -> tuple[float, float]:
    """Entropy of the weights over its maximum, and the largest weight against a natural share."""
    row = weigh(shares, exponent).agg(
        F.sum(-F.col("weight") * F.log("weight")).alias("entropy"), F.count(F.lit(1)).alias("n"),
        F.max(F.col("weight") / F.col("share")).alias("repeat")).first()
    return (row["entropy"] / math.log(row["n"]) if row["n"] > 1 else 1.0), row["repeat"]


def bisect_exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_share: float) -> float:
    """The exponent on a grid of 1 / STEPS; each probe brings one row of sums to the driver."""
    if shares.isEmpty():
        return 1.0

    def first(holds, low: int) -> int:
        """Least place from ``low`` on where ``holds``, which stays true from there; STEPS if none."""
        high = STEPS
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if holds(*_measure(shares, mid / STEPS)) else (mid + 1, high)
        return low

    place = STEPS if max_repeats is None else 0
    if target_entropy is not None:
        place = first(lambda entropy, _: entropy < target_entropy, 0)
        if _measure(shares, place / STEPS)[0] < target_entropy:
            place = max(place - 1, 0)
    if max_repeats is not None:
        place = first(lambda _, repeat: repeat * budget_share <= max_repeats, place)
    return place / STEPS


def hash_part(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
    budget_share: float = 1.0, block_tokens: int = 250_000, text: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """Draw documents so that sources have the tempered weights; a row for each pass over a document.

    ``budget_share``: tokens to draw against the tokens there are. Appends n_tokens, epoch (from 1),
    block and slot (place in the permutation of the block in that epoch). ``keep``: columns to carry.
    """
    carried = [c for c in (keep or without(docs, NEW).columns) if c.lower() not in NEW]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in carried], F.col("source").cast("string").alias("_source"),
        F.col("doc_id").cast("string").alias("_id"), word_count(F.col(text)).alias("n_tokens"))
    totals = stored(source_totals(rows.select("_source", "n_tokens")), "mix-totals")
    shares = stored(_shares(totals), "mix-shares")
    exponent = bisect_exponent(shares, target_entropy, max_repeats, budget_share)
    plan = weigh(shares, exponent).select(
        F.col("_source").alias("_of"), F.col("tokens").alias("_tokens"),
        F.round(F.lit(budget_share) * F.col("whole") * F.col("weight")).alias("_budget"),
        F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long").alias("_blocks"))
    id_hash = hash_part(F.coalesce("_id", F.lit("")))
    placed = rows.join(plan, F.col("_source").eqNullSafe(F.col("_of")), "left").withColumn(
        "block", F.coalesce(F.pmod(id_hash, F.col("_blocks")), F.pmod(id_hash, F.lit(1024))))
    in_block = Window.partitionBy("_source", "block")
    counted = placed.withColumn("_held", F.sum("n_tokens").over(in_block)).withColumn(
        "_due", F.round(F.col("_budget") * F.col("_held") / F.col("_tokens")).cast("long"))
    counted = counted.withColumn("_full", F.when(F.col("_held") > 0, F.expr("_due div _held")).otherwise(1)).withColumn(
        "_rest", F.when(F.col("_held") > 0, F.expr("_due % _held")).otherwise(0))
    passes = counted.withColumn("epoch", F.explode(F.expr("sequence(1L, greatest(1L, _full + if(_rest > 0, 1, 0)))")))
    order = Window.partitionBy("_source", "block", "epoch").orderBy(F.md5(F.concat_ws(":", F.coalesce("_id", F.lit("")), "epoch")), "_id")
    drawn = passes.withColumn("slot", F.row_number().over(order).cast("long")).withColumn(
        "_before", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens"))
    fits = (F.col("epoch") <= F.col("_full")) | ((F.col("epoch") == F.col("_full") + 1) & (2 * F.col("_before") + F.col("n_tokens") <= 2 * F.col("_rest")) & (F.col("_rest") > 0))
    return drawn.where(fits).select(*[F.col(f"`{c}`") for c in carried], *NEW)
