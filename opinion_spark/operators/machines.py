"""Many support vector machines fitted in the same passes over the data.

A sweep, a cross-validated grid or a repeated evaluation needs one machine per point, held-out part and pair of classes. They all
read the same rows, so they are fitted together: in every pass each task computes the margins of its rows for all machines
that still move as one matrix product per Arrow batch, feature map and class, and returns one summed gradient per machine; tasks add these up, so that the driver
gets one per machine and pass. The weights are moved on
the driver by L-BFGS with backtracking, for all machines at once; only weights live there, so its memory is that of the models, never
that of the data. Machines that have converged leave the passes.

The loss of a machine is ``|w|^2 / 2 + C * sum(h(1 - y * margin))`` with the hinge ``h`` smoothed over the first ``SMOOTH`` of its slope.
The RBF kernel is approximated by random Fourier features (``svm.fourier_weights``). Rows go to the class that wins most pairs,
ties to the lowest label. Rows without features or label train nothing; those without features are predicted NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.vector import doubles
from opinion_spark.operators import metrics, split
from opinion_spark.operators.sums import PART_SUMS, total_per_part
from opinion_spark.operators.svm import fourier_weights
from opinion_spark.runtime import materialized

#: Width of the quadratic part of the smoothed hinge.
SMOOTH = 0.5
#: Corrections that L-BFGS keeps.
MEMORY = 5


class Point(NamedTuple):
    """``gamma`` is 0 for the linear kernel."""

    kernel: str
    C: float
    gamma: float = 0.0


def linear_points(cs: Iterable[float]) -> list[Point]:
    return [Point("linear", c) for c in cs]


def rbf_points(cs: Iterable[float], gammas: Iterable[float]) -> list[Point]:
    return [Point("rbf", c, g) for c in cs for g in gammas]


class FeatureMap(NamedTuple):
    """Identity (no directions) or Fourier features; a constant one comes last, for the bias."""

    directions: np.ndarray | None
    phases: np.ndarray | None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x if self.directions is None else np.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])


class Group(NamedTuple):
    """The machines of one feature map, one column of the weights each."""

    features: FeatureMap
    point: np.ndarray
    part: np.ndarray
    low: np.ndarray
    high: np.ndarray
    penalty: np.ndarray


def _features(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dims)


def _rows(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Features, labels and the parts that hold the row out."""
    return _features(batch, dims), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()


def _held_out(parts: pa.ListArray, most: int) -> np.ndarray:
    """Per row and part up to ``most`` whether the row is held out of that part."""
    out = np.zeros((len(parts), most + 1), bool)
    row = np.repeat(np.arange(len(parts)), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
    part = pc.fill_null(parts.flatten(), -1).to_numpy(zero_copy_only=False)
    known = (part >= 0) & (part <= most)
    out[row[known], part[known]] = True
    return out


class _State:
    """L-BFGS for the machines of one group, row by row."""

    def __init__(self, machines: int, width: int):
        self.w = np.zeros((machines, width))
        self.g = np.zeros((machines, width))
        self.f = np.full(machines, np.inf)
        self.start = np.zeros(machines)
        self.step = np.ones(machines)
        self.direction = np.zeros((machines, width))
        self.s = np.zeros((MEMORY, machines, width))
        self.y = np.zeros((MEMORY, machines, width))
        self.rho = np.zeros((MEMORY, machines))
        self.iterations = np.zeros(machines, np.int64)
        self.active = np.ones(machines, bool)

    def trial(self) -> np.ndarray:
        on = self.active
        return self.w[on] + self.step[on, None] * self.direction[on]

    def begin(self, f: np.ndarray, g: np.ndarray) -> None:
        self.f, self.g, self.start = f, g, f.copy()
        norm = np.linalg.norm(g, axis=1)
        self.active = norm > 0
        self.direction = -g / np.maximum(norm, 1e-300)[:, None]

    def advance(self, w: np.ndarray, f: np.ndarray, g: np.ndarray, max_iter: int, tol: float) -> None:
        """Take or shorten the steps whose losses and gradients are given."""
        on = np.flatnonzero(self.active)
        slope = (self.g[on] * self.direction[on]).sum(1)
        good = f <= self.f[on] + 1e-4 * self.step[on] * slope
        back = on[~good]
        fall = self.step[back] * slope[~good]
        shrink = -fall / (2 * np.maximum(f[~good] - self.f[back] - fall, 1e-300))
        self.step[back] *= np.clip(shrink, 0.1, 0.5)
        self.active[back[self.step[back] < 1e-12]] = False
        moved = on[good]
        if not len(moved):
            return
        s, y = w[good] - self.w[moved], g[good] - self.g[moved]
        curved = (s * y).sum(1)
        gain = (self.f[moved] - f[good]) / np.maximum(np.abs(self.f[moved]), 1e-12)
        self.w[moved], self.g[moved], self.f[moved] = w[good], g[good], f[good]
        self.iterations[moved] += 1
        for kept in (self.s, self.y, self.rho):
            kept[:-1, moved] = kept[1:, moved]
        useful = curved > 1e-12
        self.s[-1, moved], self.y[-1, moved] = np.where(useful[:, None], s, 0), np.where(useful[:, None], y, 0)
        self.rho[-1, moved] = np.where(useful, 1 / np.where(useful, curved, 1), 0)
        self.active[moved[(gain < tol) | (self.iterations[moved] >= max_iter)]] = False
        self._turn(moved)

    def _turn(self, moved: np.ndarray) -> None:
        """New directions from the kept corrections."""
        q = self.g[moved].copy()
        alpha = np.zeros((MEMORY, len(moved)))
        for k in range(MEMORY - 1, -1, -1):
            alpha[k] = self.rho[k, moved] * (self.s[k, moved] * q).sum(1)
            q -= alpha[k][:, None] * self.y[k, moved]
        size = (self.y[-1, moved] ** 2).sum(1) * self.rho[-1, moved]
        q /= np.where(size > 0, size, 1)[:, None]
        for k in range(MEMORY):
            beta = self.rho[k, moved] * (self.y[k, moved] * q).sum(1)
            q += (alpha[k] - beta)[:, None] * self.s[k, moved]
        uphill = (q * self.g[moved]).sum(1) <= 0
        q[uphill] = self.g[moved][uphill]
        self.direction[moved] = -q
        self.step[moved] = 1.0


class Machines(NamedTuple):
    """Fitted machines: ``weights`` per group (machines x features, bias last), and how their fits ended."""

    points: list[Point]
    labels: list[float]
    parts: list[int]
    dims: int
    groups: list[Group]
    weights: list[np.ndarray]
    iterations: list[np.ndarray]
    objective: list[np.ndarray]
    objective_at_zero: list[np.ndarray]

    def facts(self, spark) -> DataFrame:
        """One row per machine: its point, part, classes, iterations, objective, and that of zero weights."""
        rows = []
        for group, *ends in zip(self.groups, self.iterations, self.objective, self.objective_at_zero, strict=True):
            columns = (group.point, group.part, group.low, group.high, *ends)
            for point, part, low, high, steps, reached, at_zero in zip(*(c.tolist() for c in columns), strict=True):
                rows.append((*self.points[point], part, low, high, steps, reached, at_zero))
        names = "kernel string, C double, gamma double, part int, low double, high double, iterations int, objective double, objective_at_zero double"
        return spark.createDataFrame(rows, names)

    def predictions(self, df: DataFrame, features: str, label: str, held_out: str, keep: Sequence[str] = (), only: Sequence[Point] | None = None) -> DataFrame:
        """``keep``, ``part``, ``kernel``, ``C``, ``gamma``, ``y_true``, ``y_pred`` of every row for every part that holds it out and every
        point (or those of ``only``)."""
        wanted = [i for i, p in enumerate(self.points) if only is None or p in only]
        shared = df.sparkSession.sparkContext.broadcast(self)
        given = df.select(doubles(F.col(features)), F.col(label).cast("double"), F.col(held_out), *keep)
        kept = [f for f in given.schema.fields[3:]]
        kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["part int, kernel string, C double, gamma double, y_true int, y_pred int"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            labels = np.array(own.labels)
            pairs = list(combinations(range(len(labels)), 2))
            for batch in batches:
                batch = batch.filter(pa.array([x is not None and bool(h) for x, h in zip(batch.column(0), batch.column(2).to_pylist(), strict=True)], pa.bool_()))
                if not batch.num_rows:
                    continue
                x, y, held = _rows(batch, own.dims)
                gammas = sorted({p.gamma for p in own.points})
                for gamma, group, weights in zip(gammas, own.groups, own.weights, strict=True):
                    here = [i for i in wanted if own.points[i].gamma == gamma]
                    if not here:
                        continue
                    margin = group.features(x) @ weights.T
                    for part in own.parts:
                        rows = np.array([i for i, h in enumerate(held) if part in h], np.int64)
                        if not len(rows):
                            continue
                        for point in here:
                            machines = np.flatnonzero((group.point == point) & (group.part == part))
                            votes = np.zeros((len(rows), max(len(labels), 1)), np.int64)
                            for m, (low, high) in zip(machines, pairs, strict=True):
                                upper = margin[rows, m] > 0
                                votes[upper, high] += 1
                                votes[~upper, low] += 1
                            chosen = labels[votes.argmax(1)] if len(labels) else np.full(len(rows), np.nan)
                            n, at = len(rows), own.points[point]
                            known, found = (pa.array(np.nan_to_num(v).astype(np.int32), mask=np.isnan(v)) for v in (y[rows].astype(float), chosen))
                            yield pa.RecordBatch.from_arrays(
                                [*(batch.column(3 + k).take(pa.array(rows)) for k in range(len(kept))), pa.array([part] * n, pa.int32())]
                                + [pa.array([v] * n) for v in (at.kernel, float(at.C), float(at.gamma))]
                                + [known, found],
                                [f.name for f in kept] + ["part", "kernel", "C", "gamma", "y_true", "y_pred"],
                            )

        return given.mapInArrow(run, kinds)


def _evaluated(rows: DataFrame, groups: list[Group], dims: int, active: list[np.ndarray], weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(loss, gradient) of the margin part for the active machines of every group: one pass over the rows."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((groups, active, weights))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, active, weights = shared.value
        most = max((int(g.part.max()) for g in groups if len(g.part)), default=0)
        sums = [np.zeros((w.shape[0], w.shape[1] + 1)) for w in weights]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                block = batch.slice(at, 2048)
                x, y = _features(block, dims), block.column(1).to_numpy(zero_copy_only=False)
                held = _held_out(block.column(2), most)
                for group, on, w, total in zip(groups, active, weights, sums, strict=True):
                    if not len(w):
                        continue
                    z = group.features(x)
                    for label in np.unique(y):  # only the machines that tell this class from another
                        own, upper = y == label, group.high[on] == label
                        there = np.flatnonzero(upper | (group.low[on] == label))
                        if not len(there):
                            continue
                        side, rows_of = np.where(upper[there], 1.0, -1.0), z[own]
                        over = 1.0 - side * (rows_of @ w[there].T)
                        slope = np.clip(over / SMOOTH, 0.0, 1.0) * ~held[own][:, group.part[on[there]]]
                        total[there, -1] += (slope * (over - slope * SMOOTH / 2)).sum(0)
                        total[there, :-1] -= (slope * side).T @ rows_of
        columns = [pa.array(range(len(sums)), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "sums"])

    total = [np.zeros((w.shape[0], w.shape[1] + 1)) for w in weights]
    for row in total_per_part(rows.mapInArrow(partial, PART_SUMS)).collect():  # a part per group
        total[row["part"]] += np.frombuffer(row["sums"]).reshape(total[row["part"]].shape)
    shared.destroy()
    return [(t[:, -1], t[:, :-1]) for t in total]


def train(
    df: DataFrame,
    features: str,
    label: str,
    points: Sequence[Point],
    held_out: str | None = None,
    parts: Sequence[int] = (0,),
    fourier_features: int = 500,
    seed: int = 0,
    max_iter: int = 100,
    tol: float = 1e-5,
) -> Machines:
    """Machines for every point, part and pair of labels. ``held_out``: a column of the parts that leave the row out of training."""
    out = F.col(held_out) if held_out else F.array().cast("array<int>")
    rows = df.select(doubles(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), out.alias("held"))
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    about = rows.agg(F.max(F.size("x")).alias("dims"), F.sort_array(F.collect_set("y")).alias("labels"), F.count("*").alias("n")).first()
    dims, labels = about["dims"] or 0, list(about["labels"])
    spread = min(df.sparkSession.sparkContext.defaultParallelism, 1 + about["n"] // 64)
    if rows.rdd.getNumPartitions() < spread:  # every pass multiplies matrices, so few rows are work enough for a task
        rows = rows.repartition(spread)
    rows = materialized(rows)
    pairs = list(combinations(labels, 2))
    groups = []
    for gamma in sorted({p.gamma for p in points}):
        mapped = FeatureMap(None, None) if gamma == 0 else FeatureMap(*fourier_weights(dims, fourier_features, gamma, seed))
        machines = [(i, part, low, high, p.C) for i, p in enumerate(points) if p.gamma == gamma for part in parts for low, high in pairs]
        groups.append(Group(mapped, *(np.array(c) for c in zip(*machines, strict=True))) if machines else Group(mapped, *[np.empty(0)] * 5))
    widths = [1 + (dims if g.features.phases is None else len(g.features.phases)) for g in groups]
    states = [_State(len(g.point), width) for g, width in zip(groups, widths, strict=True)]

    def losses(weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        active = [np.flatnonzero(s.active) for s in states]
        out = []
        for (loss, slope), group, on, w in zip(_evaluated(rows, groups, dims, active, weights), groups, active, weights, strict=True):
            c = group.penalty[on]
            gradient = c[:, None] * slope + w
            gradient[:, -1] -= w[:, -1]  # the bias costs nothing
            out.append((c * loss + (w[:, :-1] ** 2).sum(1) / 2, gradient))
        return out

    if pairs:
        for state, (f, g) in zip(states, losses([s.w for s in states]), strict=True):
            state.begin(f, g)
        while any(s.active.any() for s in states):
            trials = [s.trial() for s in states]
            for state, w, (f, g) in zip(states, trials, losses(trials), strict=True):
                if len(w):
                    state.advance(w, f, g, max_iter, tol)
    return Machines(
        list(points), labels, list(parts), dims, groups, *([getattr(s, n) for s in states] for n in ("w", "iterations", "f", "start"))
    )


def sweep(df: DataFrame, features: str, label: str, is_test: str, points: Sequence[Point], **fit) -> tuple[DataFrame, Machines]:
    """Scores of every point on the test rows, and the machines, fitted to the others."""
    marked = df.withColumn("held_out_of", F.when(F.col(is_test), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    fitted = train(marked, features, label, points, "held_out_of", (1,), **fit)
    predicted = fitted.predictions(marked, features, label, "held_out_of")
    return metrics.scores(predicted, ("kernel", "C", "gamma")), fitted


def repeated_evaluation(
    df: DataFrame, id_col: str, features: str, label: str, points: Sequence[Point], n_splits: int = 10, test_size: float = 0.1, **fit
) -> tuple[DataFrame, Machines]:
    """Predictions ``(id, part, kernel, C, gamma, y_true, y_pred)`` of the test rows of stratified splits (parts), and the machines."""
    cuts = materialized(split.stratified_cuts(df, id_col, label, n_splits, test_size))
    marked = split.with_test_splits(df, cuts, id_col, label, "held_out_of")
    fitted = train(marked, features, label, points, "held_out_of", range(1, n_splits + 1), **fit)
    return fitted.predictions(marked, features, label, "held_out_of", (id_col,)), fitted


class Search(NamedTuple):
    """``table(kernel, C, gamma, mean_score, two_std, is_best)``, the best point, its predictions of the test rows by a fit to all
    other rows, the predictions of every fold, and the machines."""

    table: DataFrame
    best: Point
    tested: DataFrame
    fold_predictions: DataFrame
    machines: Machines


def grid_search(
    df: DataFrame, id_col: str, features: str, label: str, fold: str, is_test: str, folds: int, points: Sequence[Point], **fit
) -> Search:
    """Cross-validated grid over the rows that are not test rows. Folds and the fits to all of these rows share their passes; test
    rows train no machine."""
    every = F.array(*[F.lit(k) for k in range(folds + 1)])
    held = F.when(F.col(is_test), every).otherwise(F.array(F.col(fold) + 1))
    marked = df.withColumn("held_out_of", held.cast("array<int>"))
    fitted = train(marked, features, label, points, "held_out_of", range(folds + 1), **fit)
    by_fold = fitted.predictions(marked.where(~F.col(is_test)), features, label, "held_out_of", (id_col,))
    point = ["kernel", "C", "gamma"]
    right = (F.col("y_true") == F.col("y_pred")).cast("double")
    table = materialized(metrics.grid_score_summary(by_fold.groupBy(*point, "part").agg(F.avg(right).alias("score")), point))
    first = table.where("is_best").select(*point).first()
    best = Point(first["kernel"], first["C"], first["gamma"]) if first else points[0]
    whole = marked.where(F.col(is_test)).withColumn("held_out_of", F.array(F.lit(0)))
    return Search(table, best, fitted.predictions(whole, features, label, "held_out_of", (id_col,), [best]), by_fold, fitted)
