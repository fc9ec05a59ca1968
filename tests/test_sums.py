"""Partial sums, shared passes of machines, and large dictionaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from compare import physical
from pyspark.sql import functions as F

from opinion_spark.operators import dictionary as D
from opinion_spark.operators import lexicon as L
from opinion_spark.operators import machines as X
from opinion_spark.operators import sums


def test_the_driver_gets_one_sum_per_part(spark):
    one = F.udf(lambda i: np.array([float(i), 1.0]).tobytes(), "binary")
    parts = spark.range(12, numPartitions=12).select((F.col("id") % 3).cast("int").alias("part"), one("id").alias("sums"))
    found = sums.total_per_part(parts).collect()
    assert {r["part"]: np.frombuffer(r["sums"]).tolist() for r in found} == {0: [18.0, 4.0], 1: [22.0, 4.0], 2: [26.0, 4.0]}
    assert len(found) == 3


def test_a_pass_gives_the_loss_and_gradient_of_every_machine(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(90, 3)), rng.integers(-1, 2, 90).astype(float)
    held = [None if i == 5 else [] if i % 4 == 0 else [i % 3, 7] for i in range(90)]
    rows = spark.createDataFrame([(a.tolist(), float(b), h) for a, b, h in zip(x, y, held, strict=True)], "x array<double>, y double, held array<int>")
    low, high, part = np.array([-1.0, -1.0, 0.0] * 3), np.array([0.0, 1.0, 1.0] * 3), np.repeat([0, 1, 2], 3)
    group = X.Group(X.FeatureMap(None, None), np.zeros(9, int), part, low, high, np.ones(9))
    on = np.array([0, 1, 3, 5, 8])
    w = rng.normal(size=(len(on), 4))
    ((loss, gradient),) = X._evaluated(rows.repartition(6), [group], 3, [on], [w])
    z = np.hstack([x, np.ones((90, 1))])
    for m, machine in enumerate(on):
        mine = [i for i in range(90) if y[i] in (low[machine], high[machine]) and part[machine] not in (held[i] or [])]
        side = np.where(y[mine] == high[machine], 1.0, -1.0)
        over = 1 - side * (z[mine] @ w[m])
        slope = np.clip(over / X.SMOOTH, 0, 1)
        assert np.isclose(loss[m], (slope * (over - slope * X.SMOOTH / 2)).sum())
        assert np.allclose(gradient[m], -(slope * side) @ z[mine])


def test_places_of_words_whichever_side_is_larger():
    for wanted, words in ((["b", "x", "a"], ["a", "b", "c", "d"]), (["b", "x", "a", "y", "c"], ["a", "b"]), ([], ["a"]), (["a"], [])):
        found = D._places(pa.array(wanted, pa.string()), pa.array(words, pa.string())).to_pylist()
        assert found == [words.index(w) if w in words else None for w in wanted]


def test_a_lexicon_of_a_million_words_is_read_inside_the_row(spark):
    lexicon = spark.range(1_000_000).select(F.concat(F.lit("w"), "id").alias("word"), (F.col("id") % 7).alias("weight"))
    docs = spark.createDataFrame([(1, ["w8", "w999999", "w8", "none"]), (2, None)], "id int, tokens array<string>")
    scored = L.sentence_scores(docs, "id", F.col("tokens"), lexicon)
    assert "Exchange" not in physical(scored) and "Join" not in physical(scored)
    assert {r["id"]: r["score"] for r in scored.collect()} == {1: 2 + 999999 % 7, 2: 0}
