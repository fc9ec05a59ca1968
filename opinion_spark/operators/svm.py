"""Support vector classification: pairwise linear machines, and an RBF approximation.

Several classes are separated pair by pair and a row goes to the class that wins most
pairs. The RBF kernel is approximated with random Fourier features (Rahimi and Recht,
2007) in front of the linear machines; the error shrinks with the square root of the
number of features, 500 or more are advised.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import combinations
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.vector import doubles, dot, let

# Parameter grids and presets.
GRID_C = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]
GRID_GAMMA = [1000.0, 100.0, 10.0, 1.0, 0.1, 0.01, 0.001]
SWEEP_VALUES = [0.1, 1.0, 100.0, 1000.0, 10000.0, 100000.0]
PRESET_RBF = {"kernel": "rbf", "C": 1000.0, "gamma": 0.001}
PRESET_LINEAR = {"kernel": "linear", "C": 0.01}


def linear_scores(features: Column, weights: Column) -> Column:
    """``array<struct<score, label>>`` for ``weights: array<struct<label, bias, w>>``."""
    return let(
        doubles(features),
        lambda x: F.transform(
            weights,
            lambda c: F.struct(
                (dot(x, c["w"]) + c["bias"]).alias("score"), c["label"].alias("label")
            ),
        ),
    )


def fourier_weights(dims: int, count: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (dims x count) and phases of a feature map for ``exp(-gamma |x-y|^2)``."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (dims, count))
    return directions, rng.uniform(0.0, 2.0 * np.pi, count)


def fourier_map(features: Column, directions: np.ndarray, phases: np.ndarray) -> Column:
    """``sqrt(2/D) cos(x W + b)`` as ``array<double>``.

    A dense matrix product per row: one matrix multiplication per Arrow batch. NULL stays NULL.
    """
    scale = float(np.sqrt(2.0 / len(phases)))

    @F.pandas_udf("array<double>")
    def project(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
        given = batch[batch.notna()]
        if len(given):
            x = np.stack(given.to_numpy()).astype(float)
            out[given.index] = list(scale * np.cos(x @ directions + phases))
        return out

    return project(doubles(features))


def _in_threads(work: Callable, items: list, parallelism: int = 4) -> list:
    """Submit independent fits side by side; each is a chain of small jobs."""
    if not items:
        return []
    pool = ThreadPool(min(parallelism, len(items)))
    try:
        return pool.map(work, items)
    finally:
        pool.close()


class _PairwiseParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter):
    kernel = Param(Params._dummy(), "kernel", "linear or rbf", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "penalty of margin violations", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "RBF width", TypeConverters.toFloat)
    fourierFeatures = Param(
        Params._dummy(), "fourierFeatures", "size of the RBF feature map", TypeConverters.toInt
    )
    seed = Param(Params._dummy(), "seed", "seed of the RBF feature map", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(
            featuresCol="features",
            labelCol="label",
            predictionCol="prediction",
            maxIter=100,
            kernel="linear",
            C=1.0,
            gamma=1.0,
            fourierFeatures=500,
            seed=0,
        )

    def _mapped(self, df: DataFrame, dims: int) -> DataFrame:
        """Add ``_x``, the vector the linear machines see."""
        source = self.getFeaturesCol()
        if self.getOrDefault(self.kernel) == "linear":
            return df.withColumn("_x", F.col(source))
        directions, phases = fourier_weights(
            dims,
            self.getOrDefault(self.fourierFeatures),
            self.getOrDefault(self.gamma),
            self.getOrDefault(self.seed),
        )
        mapped = fourier_map(vector_to_array(source), directions, phases)
        return df.withColumn("_x", array_to_vector(mapped))


class PairwiseSVC(Estimator, _PairwiseParams):
    """Linear or approximate RBF machine over any numeric labels."""

    @keyword_only
    def __init__(
        self,
        *,
        kernel: str = "linear",
        C: float = 1.0,
        gamma: float = 1.0,
        maxIter: int = 100,
        fourierFeatures: int = 500,
        seed: int = 0,
        featuresCol: str = "features",
        labelCol: str = "label",
        predictionCol: str = "prediction",
    ):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PairwiseSVCModel:
        label, features = self.getLabelCol(), self.getFeaturesCol()
        dims = df.select(F.size(vector_to_array(features)).alias("d")).first()["d"]
        rows = self._mapped(df.select(features, F.col(label).cast("double").alias("_y")), dims)
        rows = rows.select("_x", "_y").persist()
        sizes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
        labels = sorted(sizes)

        @inheritable_thread_target(df.sparkSession)
        def fit_pair(sides: tuple[float, float]) -> LinearSVCModel:
            low, high = sides
            pair = rows.where(F.col("_y").isin(low, high)).select(
                "_x", (F.col("_y") == high).cast("double").alias("_side")
            )
            # C times the summed hinge loss, as a mean loss with an L2 penalty.
            penalty = 1.0 / (self.getOrDefault(self.C) * (sizes[low] + sizes[high]))
            machine = LinearSVC(
                featuresCol="_x",
                labelCol="_side",
                regParam=penalty,
                standardization=False,
                maxIter=self.getMaxIter(),
            )
            return machine.fit(pair)

        machines = _in_threads(fit_pair, list(combinations(labels, 2)))
        rows.unpersist()
        return self._copyValues(PairwiseSVCModel(labels, machines, dims))


class PairwiseSVCModel(Model, _PairwiseParams):
    """Fitted machines, one per pair of labels in order."""

    def __init__(self, labels: list[float], machines: list[LinearSVCModel], dims: int):
        super().__init__()
        self._defaults()
        self.labels = labels
        self.machines = machines
        self.dims = dims

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = self._mapped(df, self.dims)
        pairs = list(combinations(self.labels, 2))
        wins = []
        for i, machine in enumerate(self.machines):
            side = f"_side{i}"
            # Only the side is kept; raw scores would clash between the machines.
            machine = machine.copy().setPredictionCol(side).setRawPredictionCol(f"_raw{i}")
            scored = machine.transform(scored)
            wins.append((F.col(side), *pairs[i]))
        ballots = []
        for place, label in enumerate(self.labels):
            votes = [
                (side if label == high else 1 - side)
                for side, low, high in wins
                if label in (low, high)
            ]
            count = reduce(lambda a, b: a + b, votes, F.lit(0.0))
            ballots.append(F.struct(count, F.lit(-place), F.lit(label).alias("label")))
        winner = F.array_max(F.array(*ballots))["label"]
        return scored.select(*df.columns, winner.alias(self.getPredictionCol()))

    def save(self, path: str, df: DataFrame) -> None:
        """Write the machines below ``path`` together with a one-row description."""
        params = {p.name: v for p, v in self.extractParamMap().items()}
        about = {"labels": self.labels, "dims": self.dims, "params": params}
        for i, machine in enumerate(self.machines):
            machine.write().overwrite().save(f"{path}/machine={i}")
        described = df.sparkSession.createDataFrame([(json.dumps(about),)], "about string")
        described.write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(path: str, df: DataFrame) -> PairwiseSVCModel:
        about = json.loads(df.sparkSession.read.text(f"{path}/about").first()["value"])
        pairs = range(len(about["labels"]) * (len(about["labels"]) - 1) // 2)
        machines = [LinearSVCModel.load(f"{path}/machine={i}") for i in pairs]
        model = PairwiseSVCModel(about["labels"], machines, about["dims"])
        return model._set(**about["params"])
