"""Balanced, repeated and cross-validated classifiers on MLlib.

``vectors`` is (gene, class, features) from ``feature_vectors``. Each fit is a distributed
MLlib job; folds and replicates run as concurrent jobs. Out-of-fold predictions go to a table
in the shared folder, one folder per job, so the loss of an executor costs one task.

MLlib limits tree depth to 30: unlimited depth and the larger depths of the grid map to 30.
``LinearSVC`` has the hinge loss only, so the grid has no squared hinge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.operators.enrichment import mean_sd_se
from kmerlake.operators.metrics import accuracy_f1, auc_roc, average_scores, confusion
from kmerlake.operators.ranking import hash_key, rank_by_hash
from kmerlake.operators.sampling import balanced_sample, kfold, stratified_kfold
from kmerlake.session import materialise, scratch_path

MAX_DEPTH = 30
PARALLEL_JOBS = 4

# The parameter grids.
FOREST_GRID = {
    "n_estimators": [50, 100, 500],
    "max_depth": [2, 3, 5, 10, 50, 100],
    "max_features": ["0.1", "0.25", "0.5", "0.75", "0.9999", "sqrt", "log2"],
}
SVC_GRID = {"C": [0.01, 0.1, 0.5, 1.0, 10.0, 50.0, 100.0], "max_iter": [10, 100, 1000]}


def forest(trees: int = 500, impurity: str = "entropy", depth: int | None = None, features: str = "sqrt", seed: int = 0):
    return RandomForestClassifier(
        labelCol="class", featuresCol="features", numTrees=trees, impurity=impurity,
        maxDepth=min(depth or MAX_DEPTH, MAX_DEPTH), featureSubsetStrategy=features, seed=seed)


def linear_svc(n_rows: int, c: float = 1.0, max_iter: int = 500):
    return LinearSVC(
        labelCol="class", featuresCol="features", regParam=1.0 / (c * max(n_rows, 1)), maxIter=max_iter,
        standardization=False)


def _score(model, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with a real score: probability of class 1, or the margin of an SVC."""
    scored = model.transform(rows)
    column = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.select(
        *keys, "gene", "class", F.col("prediction").cast("int").alias("predicted"),
        vector_to_array(column)[1].alias("score"))


def cross_val_predict(
    rows: DataFrame, estimators: dict[str, Callable[[int], object]], keys: Iterable[str] = (), folds: int = 10
) -> DataFrame:
    """Out-of-fold predictions (keys, setting, fold, gene, class, predicted, score).

    ``rows`` has features, ``fold`` and the key columns; each distinct key value is a separate
    data set. ``estimators`` maps a setting's name to a maker that takes the number of training rows.
    """
    spark = rows.sparkSession
    keys = list(keys)
    rows = materialise(rows)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).collect()  # one row per replicate
    path = scratch_path(spark, "predictions")

    def one(job: tuple[int, tuple]) -> None:
        number, (group, name, fold) = job
        part = rows
        for key in keys:
            part = part.where(F.col(key) == group[key])
        train, test = part.where(F.col("fold") != fold), part.where(F.col("fold") == fold)
        model = estimators[name](group["n"] - group["n"] // folds).fit(train)
        _score(model, test, [*keys, "fold"]).withColumn("setting", F.lit(name)).write.parquet(f"{path}/job={number}")

    jobs = list(enumerate(product(sizes, estimators, range(1, folds + 1))))
    with ThreadPool(PARALLEL_JOBS) as pool:
        pool.map(one, jobs)
    return spark.read.parquet(path).drop("job")


def _importances(model, vocabulary: list[str]) -> list[tuple[str, float]]:
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return [(token, float(v)) for token, v in zip(vocabulary, values.toArray())]


def fit_importance(rows: DataFrame, estimator, vocabulary: list[str]) -> DataFrame:
    """(feature, importance) of one fit; signed coefficients for an SVC."""
    return rows.sparkSession.createDataFrame(
        _importances(estimator.fit(rows), vocabulary), "feature string, importance double")


def forest_select(vectors: DataFrame, vocabulary: list[str], n: int, trees: int = 500, seed: int = 0) -> DataFrame:
    """The ``n`` features of greatest forest importance."""
    return fit_importance(vectors, forest(trees, seed=seed), vocabulary).orderBy(F.desc("importance"), "feature").limit(n)


def balanced_vectors(vectors: DataFrame, replicates: int) -> DataFrame:
    """(replicate, gene, class, features) of balanced samples."""
    sample = balanced_sample(vectors.select("gene", "class"), replicates)
    return sample.join(vectors.select("gene", "features"), "gene")


def rf_replicates(
    vectors: DataFrame, vocabulary: list[str], replicates: int = 50, repeats: int = 10, folds: int = 10,
    trees: int = 500, score: str = "f1", depth: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Per balanced replicate: ``repeats`` × (fit, shuffled k-fold score).

    Returns (replicate, mean, sd, se) of the repeat scores, a repeat scoring its mean over folds,
    and the importances averaged over repeats and replicates.
    """
    spark = vectors.sparkSession
    rows = materialise(kfold(balanced_vectors(vectors, replicates), folds, by=["replicate"]))
    makers = {str(r): (lambda n, r=r: forest(trees, depth=depth, seed=r)) for r in range(repeats)}
    predictions = cross_val_predict(rows, makers, ["replicate"], folds)
    per_fold = ["replicate", "setting", "fold"]
    scored = (
        auc_roc(predictions, per_fold).withColumnRenamed("auc", "score") if score == "auc"
        else accuracy_f1(predictions, per_fold).select(*per_fold, F.col("f1").alias("score")))
    repeat_scores = scored.groupBy("replicate", "setting").agg(F.avg("score").alias("score"))
    scores = mean_sd_se(repeat_scores, "score", ["replicate"])

    def fit(job: tuple[int, int]) -> list[tuple[str, float]]:
        replicate, repeat = job
        part = rows.where(F.col("replicate") == replicate)
        return _importances(forest(trees, depth=depth, seed=repeat).fit(part), vocabulary)

    with ThreadPool(PARALLEL_JOBS) as pool:
        fits = pool.map(fit, list(product(range(1, replicates + 1), range(repeats))))
    importance = spark.createDataFrame([x for one in fits for x in one], "feature string, importance double")
    return scores, importance.groupBy("feature").agg(F.avg("importance").alias("importance"))


def rf_cv_predict(vectors: DataFrame, replicates: int = 50, folds: int = 10, trees: int = 500, depth: int = 10) -> DataFrame:
    """Out-of-fold predictions of gini forests on balanced replicates with stratified folds."""
    rows = stratified_kfold(balanced_vectors(vectors, replicates), folds, by=["replicate"])
    return cross_val_predict(rows, {"rf": lambda n: forest(trees, "gini", depth)}, ["replicate"], folds)


def svc_cv_predict(vectors: DataFrame, replicates: int = 50, folds: int = 10, c: float = 1.0, max_iter: int = 500) -> DataFrame:
    """Out-of-fold predictions of linear SVCs on balanced replicates with stratified folds."""
    rows = stratified_kfold(balanced_vectors(vectors, replicates), folds, by=["replicate"])
    return cross_val_predict(rows, {"svc": lambda n: linear_svc(n, c, max_iter)}, ["replicate"], folds)


def _grid(vectors: DataFrame, makers: dict[str, Callable], names: dict[str, tuple], params: list[str], sets: int, folds: int) -> DataFrame:
    rows = stratified_kfold(balanced_vectors(vectors, sets), folds, by=["replicate"])
    predictions = cross_val_predict(rows, makers, ["replicate"], folds)
    per_fold = accuracy_f1(predictions, ["replicate", "setting", "fold"])
    per_set = per_fold.groupBy("replicate", "setting").agg(F.avg("accuracy").alias("score"))
    settings = vectors.sparkSession.createDataFrame(
        [(name, *map(str, values)) for name, values in names.items()],
        ", ".join(["setting string", *[f"{p} string" for p in params]]))
    return average_scores(per_set.join(settings, "setting"), params)


def grid_search_rf(vectors: DataFrame, grid: dict[str, list] = FOREST_GRID, sets: int = 10, folds: int = 10) -> DataFrame:
    """Mean accuracy per forest setting over balanced sets, best first."""
    names = {f"s{n}": values for n, values in enumerate(product(*grid.values()))}
    params = list(grid)

    def maker(values: tuple) -> Callable:
        p = dict(zip(params, values))
        return lambda n: forest(p["n_estimators"], "entropy", p["max_depth"], p["max_features"])

    return _grid(vectors, {k: maker(v) for k, v in names.items()}, names, params, sets, folds)


def grid_search_svc(vectors: DataFrame, grid: dict[str, list] = SVC_GRID, sets: int = 20, folds: int = 10) -> DataFrame:
    """Mean accuracy per linear SVC setting over balanced sets, best first."""
    names = {f"s{n}": values for n, values in enumerate(product(*grid.values()))}
    params = list(grid)

    def maker(values: tuple) -> Callable:
        p = dict(zip(params, values))
        return lambda n: linear_svc(n, p["C"], p["max_iter"])

    return _grid(vectors, {k: maker(v) for k, v in names.items()}, names, params, sets, folds)


def permutation_importance(
    presence: DataFrame, genes: DataFrame, vocabulary: list[str], folds: int = 5, trees: int = 500, seed: int = 0
) -> DataFrame:
    """(feature, importance): accuracy lost on held-out rows when one column is permuted, averaged over all folds.

    The held-out rows are numbered by md5 order; a feature's column is rotated by a shift drawn
    from its name. Only features the forest uses are scored, the others lose nothing.
    """
    spark = presence.sparkSession
    held = presence.groupBy("gene").agg(F.collect_set("token").alias("tokens"))
    rows = stratified_kfold(genes.select("gene", "class"), folds).join(held, "gene", "left").withColumn(
        "tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    rows = materialise(rows)
    vectoriser = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="tokens", outputCol="features").setBinary(True)
    lost = None
    for fold in range(1, folds + 1):
        model = forest(trees, seed=seed).fit(vectoriser.transform(rows.where(F.col("fold") != fold)))
        part = _lost_in_fold(model, vectoriser, rows.where(F.col("fold") == fold), vocabulary)
        lost = part if lost is None else lost.unionByName(part)
    mean = lost.groupBy("feature").agg((F.sum("lost") / folds).alias("lost"))
    every = spark.createDataFrame([(t,) for t in vocabulary], "feature string")
    return every.join(mean, "feature", "left").select("feature", F.coalesce("lost", F.lit(0.0)).alias("importance"))


def _lost_in_fold(model, vectoriser, rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(feature, lost) of the features that the model uses, on one held-out fold."""
    used = [token for token, value in _importances(model, vocabulary) if value > 0]
    test = rank_by_hash(rows.select("gene", "class", "tokens"), [], hash_key(F.col("gene").cast("string")), "gene")
    test = materialise(test)
    n = test.count()
    shift = lambda token: 1 + F.pmod(F.xxhash64(token), F.lit(max(n - 1, 1)))
    moved = test.select(F.explode("tokens").alias("feature"), "rank").select(
        "feature", (F.pmod(F.col("rank") - 1 + shift(F.col("feature")), F.lit(n)) + 1).alias("rank"), F.lit(True).alias("on"))
    varied = test.select("*", F.explode(F.array(*[F.lit(t) for t in used]) if used else F.array().cast("array<string>")).alias("feature"))
    varied = varied.join(moved, ["feature", "rank"], "left")
    alone = F.array(F.col("feature"))
    changed = varied.withColumn("tokens", F.array_union(
        F.array_except("tokens", alone), F.when(F.col("on"), alone).otherwise(F.array().cast("array<string>"))))
    accuracy = F.avg((F.col("prediction") == F.col("class")).cast("double"))
    base = model.transform(vectoriser.transform(test)).agg(accuracy.alias("base"))
    return model.transform(vectoriser.transform(changed)).groupBy("feature").agg(accuracy.alias("permuted")).join(
        F.broadcast(base)).select("feature", (F.col("base") - F.col("permuted")).alias("lost"))


def rf_cv_unbalanced(vectors: DataFrame, replicates: int = 10, folds: int = 10, trees: int = 500) -> DataFrame:
    """Confusion and F1 per replicate of forests on the given data, without balancing.

    Each replicate draws its own stratified folds.
    """
    every = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    rows = stratified_kfold(vectors.select("*", every), folds, by=["replicate"], seeded=True)
    predictions = cross_val_predict(rows, {"rf": lambda n: forest(trees, "gini")}, ["replicate"], folds)
    return confusion(predictions, ["replicate"])


def run_summary(scores: DataFrame, genes: DataFrame, n_features: int, method: str) -> DataFrame:
    """One result line: counts, method, mean, sd and se of the replicate scores (replicate, score)."""
    sizes = genes.agg(
        F.count_if(F.col("class") == 1).alias("n_pos"), F.count_if(F.col("class") == 0).alias("n_neg"))
    replicates = scores.agg(F.count("*").alias("replicates"))
    return mean_sd_se(scores, "score").join(F.broadcast(sizes)).join(F.broadcast(replicates)).select(
        F.lit(method).alias("method"), "n_pos", "n_neg", F.lit(n_features).cast("long").alias("n_features"),
        "replicates", "mean", "sd", "se")
