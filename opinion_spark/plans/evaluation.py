"""Scores of predictions: label pairs of ``labels``, and naive Bayes on ``embeddings``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.operators import metrics as E
from opinion_spark.plans import models as M
from opinion_spark.plans.relations import six, table

Query = Callable[[SparkSession, str], DataFrame]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


def _flat(column: str = "flat") -> F.Column:
    return F.array_join(F.transform(column, lambda n: n.cast("string")), ",").alias(column)


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_matrix(_pairs(spark, sf_dir))


def confusion_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_flat(_pairs(spark, sf_dir)).select(_flat())


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scores(_pairs(spark, sf_dir)).select(six(F.col("accuracy")).alias("accuracy"))


def micro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = E.scores(_pairs(spark, sf_dir))
    return scored.select(*[six(F.col(c)).alias(c) for c in ("micro_precision", "micro_recall")])


def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = E.scores(_pairs(spark, sf_dir))
    return scored.select(*[six(F.col(c)).alias(c) for c in ("macro_precision", "macro_recall")])


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = E.classification_report(_pairs(spark, sf_dir))
    shown = [six(F.col(c)).alias(c) for c in ("precision", "recall", "f1")]
    return report.select("label", *shown, "support")


def model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes on the embeddings: all scores and the flattened matrix."""
    predictions = M.gnb_predictions(spark, sf_dir).select(F.col("label").alias("y_true"), "y_pred")
    report = E.model_report(predictions)
    return report.select(*[six(F.col(c)).alias(c) for c in report.columns[:-1]], _flat())


def grid_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten folds of five parameter values, scored by how often they divide the label."""
    rows = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 10).alias("fold"),
        "label",
        F.explode(F.sequence(F.lit(1), F.lit(5))).alias("c"),
    )
    hit = (F.col("label") % F.col("c") == 0).cast("double")
    folds = rows.groupBy("c", "fold").agg(F.avg(hit).alias("score"))
    summary = E.grid_score_summary(folds, ["c"])
    shown = [six(F.col(x)).alias(x) for x in ("mean_score", "two_std")]
    return summary.select("c", *shown, "is_best")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        confusion_matrix,
        confusion_flat,
        accuracy,
        micro_scores,
        macro_scores,
        classification_report,
        model_report,
        grid_score_summary,
    )
}
