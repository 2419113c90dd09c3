"""MLlib classifiers (rows F2, M4-M8, M10, M11 of the survey).

Features are the 32 strand classes of length 3 in all documents. The checks run fewer trees,
replicates and grid points than the library's defaults; the rows are all balanced samples give.
"""

from __future__ import annotations

from kmerlake.operators import classify as K
from kmerlake.operators import presence as P
from kmerlake.operators import universe as U
from kmerlake.session import materialise
from querybook import fixtures as X

QUERIES, ORACLES = {}, {}
TREES, REPLICATES, FOLDS = 10, 2, 3


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def features(spark, sf):
    """(presence, vectors, vocabulary)."""
    tokens = U.canonical_words(spark, 3)
    vocabulary = [r["token"] for r in tokens.orderBy("idx").collect()]
    held = materialise(P.presence_stranded(X.sequences(spark, sf), tokens, [3]))
    return held, materialise(P.feature_vectors(held, X.genes(spark, sf), vocabulary)), vocabulary


@query("f2_forest_select")
def f2(spark, sf):
    _, vectors, vocabulary = features(spark, sf)
    return K.forest_select(vectors, vocabulary, 10, trees=50)


@query("m4_rf_replicates")
def m4(spark, sf):
    _, vectors, vocabulary = features(spark, sf)
    return K.rf_replicates(vectors, vocabulary, REPLICATES, 1, FOLDS, TREES)[0]


@query("m4_rf_replicates_importance")
def m4_importance(spark, sf):
    _, vectors, vocabulary = features(spark, sf)
    return K.rf_replicates(vectors, vocabulary, REPLICATES, 1, FOLDS, TREES, score="auc")[1]


@query("m5_rf_cv_predict")
def m5(spark, sf):
    _, vectors, _ = features(spark, sf)
    return K.rf_cv_predict(vectors, REPLICATES, FOLDS, TREES).select("replicate", "gene", "class", "predicted", "score")


@query("m6_svc_cv_predict")
def m6(spark, sf):
    _, vectors, _ = features(spark, sf)
    return K.svc_cv_predict(vectors, REPLICATES, FOLDS, max_iter=50).select("replicate", "gene", "class", "predicted", "score")


@query("m6_svc_importance")
def m6_importance(spark, sf):
    _, vectors, vocabulary = features(spark, sf)
    sample = materialise(K.balanced_vectors(vectors, 1))
    return K.fit_importance(sample, K.linear_svc(sample.count(), max_iter=50), vocabulary)


@query("m7_grid_search_rf")
def m7(spark, sf):
    _, vectors, _ = features(spark, sf)
    grid = {"n_estimators": [5, 10], "max_depth": [2, 100], "max_features": ["sqrt"]}
    return K.grid_search_rf(vectors, grid, sets=1, folds=FOLDS)


@query("m8_grid_search_svc")
def m8(spark, sf):
    _, vectors, _ = features(spark, sf)
    return K.grid_search_svc(vectors, {"C": [0.01, 1.0], "max_iter": [10, 50]}, sets=1, folds=FOLDS)


@query("m10_permutation_importance")
def m10(spark, sf):
    held, _, vocabulary = features(spark, sf)
    return K.permutation_importance(held, X.genes(spark, sf), vocabulary, folds=FOLDS, trees=TREES)


@query("m11_rf_cv_unbalanced")
def m11(spark, sf):
    _, vectors, _ = features(spark, sf)
    return K.rf_cv_unbalanced(vectors, REPLICATES, FOLDS, TREES)
