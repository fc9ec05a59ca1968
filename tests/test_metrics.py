from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opinion_spark.operators import metrics as E

# Recorded confusion matrices (rows -1, 0, 1) with their scores.
RECORDED = [
    ([[330, 5, 33], [10, 47, 12], [30, 13, 131]], 0.8314238952536824, 0.7769240379810095, 0.786428998928999),
    ([[170, 52, 146], [14, 42, 13], [47, 17, 110]], 0.5270049099836334, 0.5676120273196735, 0.507743682464872),
]


def pairs(spark, matrix):
    cells = [
        (t - 1, p - 1, n) for t, row in enumerate(matrix) for p, n in enumerate(row)
    ]
    counted = spark.createDataFrame(cells, "y_true int, y_pred int, n int")
    return counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("i", "n")


@pytest.mark.parametrize("matrix, accuracy, recall, precision", RECORDED)
def test_recorded_scores(spark, matrix, accuracy, recall, precision):
    predictions = pairs(spark, matrix)
    found = E.model_report(predictions).first()
    assert found["accuracy"] == pytest.approx(accuracy, abs=1e-12)
    assert found["micro_precision"] == found["micro_recall"] == found["accuracy"]
    assert found["macro_recall"] == pytest.approx(recall, abs=1e-12)
    assert found["macro_precision"] == pytest.approx(precision, abs=1e-12)
    assert found["flat"] == [n for row in matrix for n in row]


def test_labels_missing_on_one_side(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 3, 3)], "split int, y_true int, y_pred int")
    matrix = E.confusion_matrix(rows, ("split",)).collect()
    cells = {(r["split"], r["y_true"], r["y_pred"]): r["n"] for r in matrix}
    assert cells == {
        (1, 1, 1): 1,
        (1, 1, 2): 1,
        (1, 2, 1): 0,
        (1, 2, 2): 0,
        (2, 3, 3): 1,
    }
    scores = {r["split"]: r for r in E.scores(rows, ("split",)).collect()}
    assert scores[1]["macro_recall"] == pytest.approx(0.25)
    assert scores[1]["macro_precision"] == pytest.approx(0.5)
    assert scores[2]["accuracy"] == 1.0
    assert E.model_report(rows, ("split",)).count() == 2


def test_report_rows(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y_true int, y_pred int")
    found = {r["label"]: r for r in E.classification_report(rows).collect()}
    assert found["0"]["f1"] == pytest.approx(2 / 3)
    assert found["accuracy"]["precision"] == pytest.approx(2 / 3)
    assert found["weighted avg"]["support"] == 3


def test_best_grid_point_is_the_first_of_equals(spark):
    rows = spark.createDataFrame(
        [(1.0, 0.5), (1.0, 0.7), (2.0, 0.6), (2.0, 0.6), (3.0, 0.1)], "C double, score double"
    )
    found = {r["C"]: r for r in E.grid_score_summary(rows, ["C"]).collect()}
    assert [c for c, r in found.items() if r["is_best"]] == [1.0]
    assert found[1.0]["two_std"] == pytest.approx(0.2)


def test_rows_without_a_prediction_count_as_missed(spark):
    rows = [(1, 1), (2, 2), (2, 2), (1, None), (None, 2)]
    frame = spark.createDataFrame(rows, "y_true int, y_pred int")
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in E.confusion_matrix(frame).collect()}
    assert cells == {(1, 1): 1, (1, 2): 0, (1, None): 1, (2, 1): 0, (2, 2): 2, (2, None): 0}
    assert E.confusion_flat(frame).first()["flat"] == [1, 1, 0, 0, 0, 2]
    scored = E.scores(frame).first()
    assert scored["accuracy"] == 0.75 and scored["macro_precision"] == 1.0 and scored["macro_recall"] == 0.75
    assert {r["label"] for r in E.classification_report(frame).collect()} == {"1", "2", "accuracy", "macro avg", "weighted avg"}
    split = E.confusion_matrix(frame.selectExpr("y_true", "y_pred", "1 AS part"), ("part",))
    assert split.count() == 6
