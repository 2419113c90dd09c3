"""URL filter: a sort-merge range join of canonical keys with nested rule intervals, in DataFrame functions only.

A rule (host, path) becomes the key ``reversed host \\x01 path``; everything that starts with it is
one interval of the sorted keys. A url gives such a key for each suffix of its host that some rule
names, so it lies in the intervals of exactly the rules that fit it. Rules and distinct keys are
ranged over partitions and sorted; the sweep holds the stack of the rule opened last (that rule and
the rules around it), drops from it what the key has left, and takes the innermost. A partition
starts with the stack that the one before it ended with: one row for each partition.

Null urls and urls without ``://`` have an empty host and path and fit no rule. Repeated urls are
judged once and joined back. Of rules that fit, the longest ``host + path`` wins, then the longer
host; of rules given twice with both verdicts, ``block``. No rule: the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.llm.common import stored, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_END = "\x01"
NEW = ["host", "path", "rule", "verdict"]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def host_suffixes(host: Column, deepest: int) -> Column:
    """The reversed forms of a host and of the domains above it, of up to ``deepest`` labels; none that holds the end mark."""
    labels = F.reverse(F.split(host, r"\."))
    each = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    return F.filter(each, lambda s: ~F.contains(s, F.lit(_END)))


def rule_chains(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) by key, each with itself and the rules around it, outermost first."""
    lower = F.translate("host", UPPER, LOWER)
    keyed = (
        rules.where("host is not null and verdict is not null")
        .select(reversed_host(lower).alias("rev"), lower.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .groupBy("rev", "rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
        .select(F.concat("rev", F.lit(_END), "rule_path").alias("key"), "rev",
                F.struct(F.length(F.concat("rule_host", "rule_path")).alias("length"), F.length("rule_host").alias("host_length"),
                         F.concat("rule_host", "rule_path").alias("rule"), "verdict").alias("won")))
    starts = keyed.select("key", "rev", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
    starts = starts.select("key", "rev", "n", F.expr("substring(key, 1, n)").alias("outer"))
    around = starts.join(keyed.select(F.col("key").alias("outer"), "won"), "outer")
    return around.groupBy("key", "rev").agg(
        F.array_sort(F.collect_list(F.struct("n", F.col("outer").alias("key"), "won"))).alias("stack"))


def sweep(keys: DataFrame, chains: DataFrame) -> DataFrame:
    """The innermost rule around each distinct key: (key, won)."""
    kind = chains.schema["stack"].dataType
    events = chains.select("key", F.lit(0).alias("kind"), "stack").unionByName(
        keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("stack")))
    ranged = stored(
        events.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()), "url-sweep")
    ends = ranged.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("end"))
    parts = ranged.select("part").distinct().join(ends, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("opened", F.last("stack", ignorenulls=True).over(so_far)).where("kind = 1")
    active = F.filter(F.coalesce("opened", "carried"), lambda r: F.startswith(F.col("key"), r["key"]))
    return (
        swept.join(F.broadcast(carried), "part")  # one row for each partition
        .select("key", F.try_element_at(active, F.lit(-1))["won"].alias("won")).where("won is not null"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Append host, path, rule and verdict to every row of ``pages``."""
    address = F.col(url).cast("string")
    judged = without(pages.withColumns({"_host": host_of(address), "_path": path_of(address)}), NEW)
    chains = stored(rule_chains(rules), "url-rules")
    places = stored(judged.select("_host", "_path").distinct(), "url-places")
    # No rule fits a longer end of a host than the deepest rule has labels.
    deepest = chains.agg(F.max(F.size(F.split("rev", r"\.")))).first()[0] or 1
    suffixes = places.select("_host", "_path", F.explode(host_suffixes(F.col("_host"), deepest)).alias("rev"))
    keys = suffixes.join(chains.select("rev").distinct(), "rev", "left_semi").select(
        "_host", "_path", F.concat("rev", F.lit(_END), "_path").alias("key"))
    found = keys.join(sweep(keys.select("key").distinct(), chains), "key")
    best = stored(found.groupBy("_host", "_path").agg(F.max("won").alias("won")), "url-best")
    out = judged.join(best, ["_host", "_path"], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in judged.columns if c not in ("_host", "_path")],
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
