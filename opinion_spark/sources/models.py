"""Saving and reloading fitted models."""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession


def save_kmeans(model: KMeansModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_kmeans(path: str) -> KMeansModel:
    return KMeansModel.load(path)


def save_parameters(params: DataFrame, path: str) -> None:
    """A model that is a parameter table (naive Bayes, cluster centres)."""
    params.write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
