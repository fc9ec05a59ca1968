"""Splits, clustering, naive Bayes and support vector machines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.functions import text as T
from opinion_spark.operators import bayes as B
from opinion_spark.operators import centres as Z
from opinion_spark.operators import cluster as K
from opinion_spark.operators import machines as X
from opinion_spark.operators import metrics as E
from opinion_spark.operators import split as S
from opinion_spark.operators import svm
from opinion_spark.operators import vocabulary as V
from opinion_spark.operators import weights as W
from opinion_spark.plans.relations import significant, six, table, texts, tokenised
from opinion_spark.runtime import materialized

Query = Callable[[SparkSession, str], DataFrame]

# Fourier features of the RBF machines below.
FIT_FEATURES = 500


# --- splits ---


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return S.train_test_split(labels, "doc_id", 0.1, 109)


def stratified_shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return S.stratified_shuffle_split(labels, "doc_id", "quality", 5, 0.1)


def kfold_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return S.kfold_contiguous(labels, "doc_id", folds=10)


# --- clustering ---


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _first_centres(embeddings: DataFrame) -> DataFrame:
    """Five rows as starting centres."""
    return embeddings.where("vec_id < 5").select(
        F.col("vec_id").cast("int").alias("cluster"),
        F.col("embedding").cast("array<double>").alias("centre"),
    )


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    near = K.assign(rows, _first_centres(rows), "embedding")
    return near.select("vec_id", "kmean_label", six(F.col("dist2")).alias("dist2"))


def kmeans_lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    moved = K.lloyd_step(rows, _first_centres(rows), "embedding")
    cells = moved.select("cluster", F.posexplode("centre").alias("dim", "value"))
    return cells.withColumn("value", six(F.col("value")))


def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = K.as_vectors(_embeddings(spark, sf_dir), "embedding").select("vec_id", "features")
    model = K.fit(vectors, k=5, starts=10, max_iter=300)
    return model.transform(vectors).groupBy("kmean_label").agg(F.count("*").alias("n"))


def wcss_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = K.total_sum_of_squares(_embeddings(spark, sf_dir), "embedding")
    return total.withColumn("wcss", six(F.col("wcss")))


def _elbow_runs(spark: SparkSession, sf_dir: str) -> list[Z.Run]:
    return Z.best_per_k(Z.fit_all(_embeddings(spark, sf_dir), "embedding", range(1, 26), starts=10, max_iter=300))


def wcss_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elbow table for k from 1 to 25, ten starts each."""
    rows = [(r.k, r.wcss) for r in _elbow_runs(spark, sf_dir)]
    return spark.createDataFrame(rows, "k int, wcss double")


def wcss_sweep_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every k whatever the centres are: rows counted once, and the sum of squares of a new assignment to the
    centres, which is below that of one cluster."""
    rows, runs = _embeddings(spark, sf_dir), _elbow_runs(spark, sf_dir)
    centres = materialized(Z.centre_rows(runs, spark))
    reported = spark.createDataFrame([(r.k, r.wcss) for r in runs], "k int, wcss double")
    near = K.assign(rows.select("embedding"), centres, "embedding", by="k")
    again = near.groupBy("k").agg(F.count("*").alias("n_rows"), F.sum("dist2").alias("again"))
    total = K.total_sum_of_squares(rows, "embedding").select("wcss").scalar()
    sizes = centres.groupBy("k").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_assigned"))
    joined = again.join(reported, "k").join(sizes, "k")
    return joined.select(
        "k",
        "n_rows",
        "n_assigned",
        "n_clusters",
        (F.abs(F.col("again") - F.col("wcss")) <= 1e-6 * F.col("again")).alias("same_sum"),
        (F.col("wcss") <= total * 1.000001).alias("below_total"),
    )


# --- naive Bayes ---


def gnb_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = B.fit(_embeddings(spark, sf_dir), "label", "embedding")
    params = model.select("label", "prior", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "c"))
    params = params.select("label", "prior", "dim", "c.*")
    return params.select(
        "label", "dim", six(F.col("prior")).alias("prior"), *[six(F.col(c)).alias(c) for c in ("mean", "var")]
    )


def gnb_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    return B.predict(rows, B.fit(rows, "label", "embedding"), "embedding")


def gnb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = gnb_predictions(spark, sf_dir)
    return scored.select("vec_id", "y_pred", six(F.col("score")).alias("score"))


def nb_repeated_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    predictions = B.repeated_evaluation(rows, "vec_id", "label", "embedding", 10, 0.1)
    scored = E.scores(predictions, ("split",))
    return scored.select("split", *[six(F.col(c)).alias(c) for c in scored.columns[1:]])


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels (NULL: none)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return materialized(texts(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left"))


def _term_weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """TF-IDF of all documents over all terms, and the documents with their labels (NULL: none)."""
    tokens = texts(spark, sf_dir, "documents", "text").select("doc_id", T.clean_tokens(F.col("text")).alias("tokens"))
    # Training and scoring both read the weights.
    return materialized(W.tfidf(tokens, "doc_id", F.col("tokens"))), _known(spark, sf_dir)


def _term_model(weights: DataFrame, known: DataFrame) -> DataFrame:
    return B.term_parameters(B.fit_terms(weights, known.where(F.col("label").isNotNull()), "doc_id"))


def term_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the labelled documents, every document predicted."""
    weights, known = _term_weights(spark, sf_dir)
    return B.predict_terms(weights, known, materialized(_term_model(weights, known)), "doc_id")


def term_clusters(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Every document with its cluster: k-means on the TF-IDF of all documents; ``docs(doc_id, tokens)`` are these, where the caller has them."""
    docs = tokenised(spark, sf_dir, "doc_id") if docs is None else docs
    # Frequent terms first: most cells then lie close together in the centres.
    terms = W.numbered_terms(materialized(V.document_frequency(docs, F.col("tokens"))), F.desc("df"))
    size, n = terms.count(), docs.count()
    if 5 * 8 * size > Z.MODEL_BYTES:
        weights, known = _term_weights(spark, sf_dir)
        return Z.fit_terms(weights, known, "doc_id", k=5).labels
    rows = W.sparse_features(docs, "doc_id", F.col("tokens"), terms, n)
    return Z.fit_sparse(rows, _known(spark, sf_dir), "doc_id", size, k=5)[0]


def text_kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first assignment of that fit, and the centres that follow from it."""
    weights, known = _term_weights(spark, sf_dir)
    first = Z.first_rows(weights, "doc_id", 5)
    centres = weights.join(F.broadcast(first), "doc_id").select("cluster", "term", F.col("weight").alias("value"))
    labels = materialized(K.assign_terms(weights, known, centres, "doc_id"))
    moved = Z.term_centres(weights, labels, "doc_id")
    return moved.select("cluster", "term", six(F.col("value")).alias("value"))


def gnb_fit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = _term_model(*_term_weights(spark, sf_dir))
    return params.select(
        "label", F.col("dim").alias("term"), *[six(F.col(c)).alias(c) for c in ("mean", "var")]
    )


def gnb_predict_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = term_predictions(spark, sf_dir)
    return scored.select("doc_id", "y_pred", significant(F.col("score")).alias("score"))


# --- support vector machines ---


def svm_linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with given weights: ten classes, one weight vector each."""
    weight = "transform(sequence(0, 63), d -> ((7 * c + 3 * d) % 11 - 5) / 10.0D)"
    given = spark.range(10).select(F.col("id").cast("int").alias("c"))
    given = given.select(
        F.col("c").alias("label"), F.lit(0.0).alias("bias"), F.expr(weight).alias("w")
    )
    weights = given.select(F.sort_array(F.collect_list(F.struct("label", "bias", "w")))).scalar()
    rows = _embeddings(spark, sf_dir).withColumn("weights", weights)
    best = B.best_class(svm.linear_scores(F.col("embedding"), F.col("weights")))
    scored = rows.select("vec_id", best.alias("b"))
    return scored.select("vec_id", F.col("b.label").alias("y_pred"), six(F.col("b.score")).alias("score"))


def rff_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature map with given directions and phases."""
    j, d = np.arange(FIT_FEATURES), np.arange(64)
    directions = ((7 * j[None, :] + 3 * d[:, None]) % 11 - 5) / 10.0
    rows = _embeddings(spark, sf_dir)
    mapped = svm.fourier_map(F.col("embedding"), directions, j / 10.0)
    cells = rows.select("vec_id", F.posexplode(mapped).alias("j", "z"))
    return cells.withColumn("z", six(F.col("z")))


def _three_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the ten labels folded to -1, 0, 1, a tenth marked as test rows."""
    rows = _embeddings(spark, sf_dir).select("vec_id", (F.col("label") % 3 - 1).alias("label"), "embedding")
    return S.train_test_split(rows, "vec_id")


def _confusion_after_fit(spark: SparkSession, sf_dir: str, point: X.Point) -> DataFrame:
    _, fitted = X.sweep(_three_classes(spark, sf_dir), "embedding", "label", "is_test", [point], fourier_features=FIT_FEATURES)
    marked = _three_classes(spark, sf_dir).where("is_test").withColumn("part", F.array(F.lit(1)))
    return E.confusion_matrix(fitted.predictions(marked, "embedding", "label", "part").select("y_true", "y_pred"))


def svm_linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion_after_fit(spark, sf_dir, X.Point("linear", 1.0))


def svm_rbf_approx_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion_after_fit(spark, sf_dir, X.Point("rbf", 1.0, 0.1))


def _sweep(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, X.Machines]:
    points = X.linear_points(svm.SWEEP_VALUES) + X.rbf_points(svm.SWEEP_VALUES, svm.SWEEP_VALUES)
    return X.sweep(_three_classes(spark, sf_dir), "embedding", "label", "is_test", points, fourier_features=FIT_FEATURES)


def svm_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all 42 points."""
    return _sweep(spark, sf_dir)[0]


def svm_sweep_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every point of the sweep whatever its weights are: machines, test rows scored, an objective that beats zero weights."""
    _, fitted = _sweep(spark, sf_dir)
    marked = _three_classes(spark, sf_dir).where("is_test").withColumn("part", F.array(F.lit(1)))
    scored = fitted.predictions(marked, "embedding", "label", "part", ("vec_id",)).groupBy("kernel", "C", "gamma").agg(
        F.countDistinct("vec_id").alias("n_rows"), F.count("*").alias("n_scored"), F.sum("y_true").alias("label_sum")
    )
    ends = fitted.facts(spark).groupBy("kernel", "C", "gamma").agg(
        F.count("*").alias("n_machines"),
        six(F.sum("objective_at_zero")).alias("objective_at_zero"),
        F.bool_and((F.col("objective") > 0) & (F.col("objective") < F.col("objective_at_zero"))).alias("improved"),
    )
    return ends.join(scored, ["kernel", "C", "gamma"])


def _grid(spark: SparkSession, sf_dir: str) -> X.Search:
    rows = _three_classes(spark, sf_dir)
    folded = S.kfold_contiguous(rows.where(~F.col("is_test")), "vec_id", folds=10)
    marked = folded.unionByName(rows.where("is_test").withColumn("fold", F.lit(None).cast("int")))
    points = X.linear_points(svm.GRID_C) + X.rbf_points(svm.GRID_C, svm.GRID_GAMMA)
    return X.grid_search(marked, "vec_id", "embedding", "label", "fold", "is_test", 10, points, fourier_features=FIT_FEATURES)


def svm_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 56 points over ten folds."""
    return _grid(spark, sf_dir).table


def svm_grid_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's best point, fitted to all training rows, on the test rows: scores per class and in all."""
    return E.classification_report(_grid(spark, sf_dir).tested.select("y_true", "y_pred"))


def svm_repeated_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both presets on ten splits: counts, scores and flat matrix per split."""
    rows = _three_classes(spark, sf_dir)
    points = [X.Point(**svm.PRESET_LINEAR), X.Point(**svm.PRESET_RBF)]
    predicted, _ = X.repeated_evaluation(rows, "vec_id", "embedding", "label", points, 10, 0.1, fourier_features=FIT_FEATURES)
    predicted = materialized(predicted.withColumnRenamed("part", "split"))
    by = ("kernel", "split")
    counts = predicted.groupBy(*by).agg(F.count("*").alias("n_test")).withColumn("n_train", F.lit(rows.count()) - F.col("n_test"))
    flat = F.array_join(F.transform("flat", lambda n: n.cast("string")), ",").alias("flat")
    report = E.model_report(predicted, by)
    return counts.join(report.select(*[c for c in report.columns if c != "flat"], flat), list(by))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        train_test_split,
        stratified_shuffle_split,
        kfold_contiguous,
        kmeans_assign,
        kmeans_lloyd_step,
        kmeans_fit,
        wcss_total,
        wcss_sweep,
        wcss_sweep_facts,
        text_kmeans_step,
        gnb_fit,
        gnb_predict,
        nb_repeated_cv,
        gnb_fit_terms,
        gnb_predict_terms,
        svm_linear_score,
        rff_transform,
        svm_linear_fit,
        svm_rbf_approx_fit,
        svm_sweep,
        svm_sweep_facts,
        svm_grid_search,
        svm_grid_report,
        svm_repeated_cv,
    )
}
