"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

A text's features are hashed words and word pairs, the same of word shapes (letters and digits by kind, marks as they
are), and how often word pairs repeat; each family's values are shares, and the whole vector has length one. FTRL-proximal
with per-coordinate rates is trained in one task on a bounded sample of labelled rows (``SAMPLE``, those of least
hash); the model has a fixed size (``2 ** BITS`` weights) and is sent to all tasks, which score rows one by one.

A NULL or blank text has no features and gets the model's bias. Rows without an id are never held out and never
learnt from. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.llm import words as W

BITS = 18
#: Labelled rows to learn from at most.
SAMPLE = 8_000
EPOCHS = 3
THRESHOLD = 0.3
FOLDS = 5

_SHAPES = W.byte_table({**{b: 1 for b in range(97, 123)}, **{b: 2 for b in range(65, 91)}, **{b: 3 for b in range(48, 58)}, **{b: 4 for b in range(128, 256)}})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _family(hashes: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of one family, their shares, and their counts."""
    values, counts = np.unique(hashes, return_counts=True)
    at = W.mixed(values + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS)
    return at.astype(np.int64), np.sqrt(counts / max(len(hashes), 1)), counts


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every text its feature numbers and values."""
    plain, shapes = W.word_table(column, fold=False), W.word_table(column, fold=False, table=_SHAPES)
    for low, high in zip(plain.first[:-1].tolist(), plain.first[1:].tolist(), strict=True):
        own, shape = plain.hashes[low:high], shapes.hashes[low:high]
        if not len(own):
            yield np.empty(0, np.int64), np.empty(0)
            continue
        pairs = W.window_hashes(own, 2)
        families = [_family(x, salt) for salt, x in enumerate((own, pairs, shape, W.window_hashes(shape, 2)), 1)]
        often = families[1][2]
        levels = np.floor(np.log2(often)).astype(np.uint64)
        families.append(_family(np.repeat(levels, often), 5))
        at, value = np.concatenate([f[0] for f in families]), np.concatenate([f[1] for f in families])
        yield at, value / np.sqrt((value * value).sum())


class FollowTheLeader:
    """FTRL-proximal logistic regression."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, 1 << BITS), np.append(value, 1.0)
        w = self.weights(at)
        error = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label
        g = error * value
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        np.add.at(self.z, at, g - sigma * w)
        np.add.at(self.n, at, g * g)


def trained(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights, the bias last, learnt in one task from at most SAMPLE rows, in the order of a hash of the id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, 2):
                made = list(features(part.column(2)))
                columns = [pa.array([at.tobytes() for at, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["order", "label", "at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for label, at, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                held.append((np.frombuffer(at, np.int64), np.frombuffer(value), label))
        model = FollowTheLeader()
        for _ in range(EPOCHS):
            for row in held:
                model.learn(*row)
        weights = model.weights(slice(None)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    order = F.xxhash64(F.col(doc_id), F.lit(6)).alias("order")
    picked = (
        labelled.select(order, F.col(label).cast("int").alias("label"), F.col(text).cast("string").alias("text"))
        .where("label in (0, 1)")
        .mapInArrow(rows, "order long, label int, at binary, value binary")
        .orderBy("order", "label", "at")
        .limit(SAMPLE)
        .repartition(1)
        .sortWithinPartitions("order", "label", "at")
    )
    found = picked.mapInArrow(learn, "weights binary").first()
    # Without a labelled row there is nothing to learn: every score is one half.
    return np.frombuffer(found["weights"], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """At most SAMPLE labelled rows outside the held-out fold, with their texts. The labels are few (bounded by SAMPLE) and
    go to the documents."""
    known = (
        labels.select(F.col(doc_id).alias("label_id"), F.col(label).alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
        .orderBy(F.xxhash64("label_id", F.lit(6)), "label_id", "label")
        .limit(SAMPLE)
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return texts.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")


def scored(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in batches:
            for part in W.slices(batch, 2):
                sums = np.array([w[at] @ value for at, value in features(part.column(2))], np.float64) + w[-1]
                score = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
                columns = [part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
