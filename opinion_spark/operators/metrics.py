"""Evaluation of predictions ``(y_true, y_pred)``.

Rows are reduced once, to counts per (true, predicted) pair; every score is computed
from these few counts. ``by`` evaluates several splits or models side by side.

A row without a prediction counts in its class's support and is right for no class: the matrix shows it
in a column of its own (``y_pred`` NULL, first in the flat form), and no class NULL enters the averages. Rows without
a true label cannot be judged and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    judged = predictions.where(F.col("y_true").isNotNull())
    return judged.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, y_true, y_pred, n)`` over the full grid of labels, 0 where none occurred.

    The labels of a model are few; the grid is their square, each cell looked up by a hash join.
    """
    counts = pair_counts(predictions, by)
    sides = counts.select(*by, F.explode(F.array("y_true", "y_pred")).alias("label"))
    labels = sides.groupBy(*by).agg(F.collect_set("label").alias("labels"), F.bool_or(F.col("label").isNull()).alias("_none"))
    grid = labels.select(*by, "labels", "_none", F.explode("labels").alias("y_true"))
    missing = F.array(F.lit(None).cast(counts.schema["y_pred"].dataType))
    columns = F.when(F.col("_none"), F.concat("labels", missing)).otherwise(F.col("labels"))
    grid = grid.select(*by, "y_true", F.explode(columns).alias("y_pred"))
    found = counts.select(*[F.col(c).alias(f"_{c}") for c in (*by, "y_true", "y_pred")], "n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "y_true", "y_pred")]
    joined = grid.join(found, same, "left")
    return joined.select(*by, "y_true", "y_pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def confusion_flat(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, flat)``: the matrix row by row, labels sorted."""
    cells = F.sort_array(F.collect_list(F.struct("y_true", "y_pred", "n")))
    matrix = confusion_matrix(predictions, by).groupBy(*by).agg(cells.alias("cells"))
    return matrix.select(*by, F.col("cells.n").alias("flat"))


def label_totals(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, label, tp, support, predicted)``."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col("y_true").alias("label"),
            hit.alias("tp"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
        ),
        F.struct(
            F.col("y_pred").alias("label"),
            zero.alias("tp"),
            zero.alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    stacked = pair_counts(predictions, by).select(*by, F.inline(sides))
    names = ("tp", "support", "predicted")
    known = stacked.where(F.col("label").isNotNull())
    return known.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in names])


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _with_label_scores(totals: DataFrame) -> DataFrame:
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    # 2PR/(P+R) in counts: predicted + support is the sum of both denominators.
    f1 = _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    return totals.withColumns({"precision": precision, "recall": recall, "f1": f1})


def scores(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, micro and macro precision and recall, one row per ``by``."""
    per_label = _with_label_scores(label_totals(predictions, by))
    tp, support, predicted = (F.sum(c) for c in ("tp", "support", "predicted"))
    return per_label.groupBy(*by).agg(
        _ratio(tp, support).alias("accuracy"),
        _ratio(tp, predicted).alias("micro_precision"),
        _ratio(tp, support).alias("micro_recall"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
    )


def classification_report(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per-class rows plus accuracy, macro average and weighted average rows."""
    per_label = _with_label_scores(label_totals(predictions, by))
    names = ("precision", "recall", "f1")
    sums = per_label.groupBy(*by).agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in names],
    )
    summary = F.array(
        _report_row("accuracy", ["accuracy"] * 3),
        _report_row("macro avg", [f"macro_{c}" for c in names]),
        _report_row("weighted avg", [f"w_{c}" for c in names]),
    )
    rows = per_label.select(
        *by, F.col("label").cast("string").alias("label"), *names, "support"
    )
    return rows.unionByName(sums.select(*by, F.inline(summary)))


def _report_row(label: str, columns: list[str]) -> Column:
    precision, recall, f1 = columns
    return F.struct(
        F.lit(label).alias("label"),
        F.col(precision).alias("precision"),
        F.col(recall).alias("recall"),
        F.col(f1).alias("f1"),
        F.col("support").alias("support"),
    )


def model_report(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores plus the flattened confusion matrix, one row per ``by``."""
    flat = confusion_flat(predictions, by)
    measured = scores(predictions, by)
    if by:
        return measured.join(flat, list(by))
    return measured.withColumn("flat", flat.scalar())


def grid_score_summary(fold_scores: DataFrame, params: list[str]) -> DataFrame:
    """Mean score and twice its population deviation per parameter set; best one marked.

    ``fold_scores`` has the parameter columns and ``score``, one row per fold. Equal
    means go to the first parameter set in column order.
    """
    summary = fold_scores.groupBy(*params).agg(
        F.avg("score").alias("mean_score"),
        (2 * F.stddev_pop("score")).alias("two_std"),
    )
    first_best = F.min_by(F.struct(*params), F.struct(-F.col("mean_score"), *params))
    best = summary.select(first_best).scalar()
    return summary.withColumn("is_best", F.struct(*params) == best)
