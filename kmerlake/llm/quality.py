"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to column expressions.

Small trees are grown on labelled texts; each path from a root to a node is a rule, a conjunction
of comparisons over statistics. A lasso logistic regression over the rules' 0/1 values keeps few of
them. The rules kept and their weights become one Spark expression, so scoring is a projection.

Labels are learned from a bounded sample: of the labelled rows, the ``fit_rows`` with the smallest
hash of the id (a parameter). All texts are scored, as a whole. Null and empty texts have all
statistics zero and get the score these lead to. If the sample lacks one of the two labels, the
score is the share of label 1 in it (one half for an empty sample). Labels given twice for an id
count twice; null labels and ids are not learned from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.llm.common import stored, without

THRESHOLD = 0.3
_SPACE = r"[\x20\x09-\x0D]+"


def _count(pattern: str) -> Column:
    """Characters of a class; ``pattern`` matches the others."""
    return F.length(F.regexp_replace("_t", pattern, ""))


def statistics(df: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """Append a double column for each statistic of the whole text; returns their names."""
    held = df.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    held = held.withColumns({
        "_words": F.filter(F.split("_t", _SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split("_t", "\n"), lambda x: x != ""),
        "_chars": F.greatest(F.length("_t"), F.lit(1))})
    held = held.withColumns({
        "_n_words": F.greatest(F.size("_words"), F.lit(1)), "_n_lines": F.greatest(F.size("_lines"), F.lit(1)),
        "_digits": _count(r"[^0-9]+"), "_upper": _count(r"[^A-Z]+"), "_symbols": _count(r"[^#*$%&|<>]+"),
        "_stops": _count(r"[^.!?]+"), "_shouts": _count(r"[^!]+"), "_bars": _count(r"[^|]+"), "_accents": _count(r"[\x00-\x7F]+"),
        "_odd": _count(r"[\p{L}\p{N}\p{P}\p{S}\s]+")})
    per_char = {name: F.col(f"_{name}") / F.col("_chars")
                for name in ("digits", "upper", "symbols", "stops", "shouts", "bars", "accents", "odd")}
    out = {
        **per_char,
        "words": F.log1p(F.size("_words")),
        "word_length": F.col("_chars") / F.col("_n_words"),
        "distinct_words": F.size(F.array_distinct("_words")) / F.col("_n_words"),
        "distinct_lines": F.size(F.array_distinct("_lines")) / F.col("_n_lines"),
        "line_words": F.log1p(F.col("_n_words") / F.col("_n_lines")),
        "long_words": F.size(F.filter("_words", lambda w: F.length(w) > 16)) / F.col("_n_words")}
    names = [f"_f_{name}" for name in out]
    full = held.select(*[F.col(f"`{c}`") for c in df.columns], *[v.cast("double").alias(n) for n, v in zip(names, out.values())])
    return full, names


@dataclass(frozen=True)
class Rule:
    """Comparisons (statistic, True for ``<=``, threshold) that must all hold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(n) <= t if low else F.col(n) > t for n, low, t in self.tests])


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weighted], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def _paths(node, names: list[str], tests: tuple = ()) -> list[Rule]:
    """Rules of a tree node and all below it; a test that a later one on the same statistic implies is dropped."""
    rules = [Rule(tuple(sorted(tests)))] if tests else []
    if node.getClass().getSimpleName() != "InternalNode":
        return rules
    name, threshold = names[node.split().featureIndex()], node.split().threshold()
    rest = lambda low: tuple(t for t in tests if t[:2] != (name, low))
    rules += _paths(node.leftChild(), names, (*rest(True), (name, True, threshold)))
    return rules + _paths(node.rightChild(), names, (*rest(False), (name, False, threshold)))


def fit_rules(
    docs: DataFrame, labels: DataFrame, label: str, text: str = "text", fit_rows: int = 20_000, trees: int = 24, depth: int = 3,
    penalty: float = 0.002, seed: int = 11,
) -> RuleModel:
    """Learn rules from labelled documents. The id sample is joined by broadcast: ``fit_rows`` ids at most."""
    marked = labels.where(F.col(label).isNotNull()).select(F.col("doc_id"), F.col(label).cast("double").alias("_label"))
    known = marked.join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "_label").limit(fit_rows)
    full, names = statistics(docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(sample), "doc_id"), "_text")
    rows = stored(full.select("_label", *names), "quality-sample")
    shares = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_label").alias("mean")).first()
    if not shares["n"] or shares["mean"] in (0.0, 1.0):
        mean = 0.5 if not shares["n"] else min(max(shares["mean"], 1e-6), 1 - 1e-6)
        return RuleModel(math.log(mean / (1 - mean)), ())
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5,
        featureSubsetStrategy="onethird")
    model = forest.fit(VectorAssembler(inputCols=names, outputCol="_x").transform(rows))
    rules = sorted({r for tree in model.trees for r in _paths(tree._call_java("rootNode"), names)}, key=lambda r: r.tests)
    if not rules:
        return RuleModel(math.log(shares["mean"] / (1 - shares["mean"])), ())
    held = stored(rows.select("_label", *[r.column().cast("double").alias(f"_r{k}") for k, r in enumerate(rules)]), "quality-rules")
    lasso = LogisticRegression(featuresCol="_x", labelCol="_label", regParam=penalty, elasticNetParam=1.0, maxIter=100)
    fitted = lasso.fit(VectorAssembler(inputCols=[f"_r{k}" for k in range(len(rules))], outputCol="_x").transform(held))
    weights = fitted.coefficients.toArray()
    return RuleModel(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def score(docs: DataFrame, model: RuleModel, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    rest = without(docs, ["score", "predicted"])
    carried = [c for c in (rest.columns if keep is None else keep)]
    full, _ = statistics(docs.select(*[F.col(f"`{c}`") for c in carried], F.col(text).alias("_text")), "_text")
    scored = full.withColumn("score", model.column())
    return scored.select(*[F.col(f"`{c}`") for c in carried], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
