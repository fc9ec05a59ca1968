from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinion_spark.operators import bayes as B
from opinion_spark.operators import centres
from opinion_spark.operators import cluster as K
from opinion_spark.operators import metrics as E
from opinion_spark.operators import machines, svm
from opinion_spark.operators import split as S
from opinion_spark.operators import weights as W
from opinion_spark.sources import models as saved


@pytest.fixture(scope="module")
def blobs(spark):
    """Three groups of points around fixed places, labels -1, 0, 1."""
    rng = np.random.default_rng(5)
    places = {-1: (0.0, 0.0, 1.0), 0: (4.0, 0.0, 1.0), 1: (0.0, 4.0, 1.0)}
    rows = []
    for label, place in places.items():
        for _ in range(80):
            x = rng.normal(place, (0.7, 0.7, 0.0))
            rows.append((len(rows), label, [float(v) for v in x]))
    return spark.createDataFrame(rows, "id int, label int, x array<double>")


def gaussian(train, test):
    """Gaussian naive Bayes in numpy."""
    x, y = np.array([r["x"] for r in train]), np.array([r["label"] for r in train])
    eps = 1e-9 * x.var(axis=0).max()
    classes = sorted(set(y))
    scores = []
    for c in classes:
        part = x[y == c]
        mean, var = part.mean(axis=0), part.var(axis=0) + eps
        base = np.log(len(part) / len(x)) - 0.5 * np.log(2 * np.pi * var).sum()
        t = np.array([r["x"] for r in test])
        scores.append(base - 0.5 * ((t - mean) ** 2 / var).sum(axis=1))
    return [classes[i] for i in np.argmax(np.array(scores), axis=0)]


def test_naive_bayes_with_a_constant_feature(blobs):
    rows = blobs.orderBy("id").collect()
    predicted = B.predict(blobs, B.fit(blobs, "label", "x"), "x").orderBy("id").collect()
    assert [r["y_pred"] for r in predicted] == gaussian(rows, rows)


def test_repeated_evaluation_trains_on_the_training_part(blobs):
    rows = {r["id"]: r for r in blobs.collect()}
    cuts = S.stratified_cuts(blobs, "id", "label", 3, 0.1)
    tests = {r["id"]: r["test_splits"] for r in S.with_test_splits(blobs, cuts, "id", "label").collect()}
    found = B.repeated_evaluation(blobs, "id", "label", "x", 3, 0.1).collect()
    for split in (1, 2, 3):
        mine = sorted((r for r in found if r["split"] == split), key=lambda r: r["id"])
        test = [rows[i] for i in sorted(rows) if split in tests[i]]
        train = [rows[i] for i in sorted(rows) if split not in tests[i]]
        assert [r["id"] for r in mine] == [r["id"] for r in test]
        assert [r["y_pred"] for r in mine] == gaussian(train, test)


def test_naive_bayes_on_sparse_terms_equals_the_dense_one(spark):
    rng = np.random.default_rng(2)
    x = rng.poisson(0.6, (60, 5)) * rng.uniform(0.5, 2.0, (60, 5))
    x[7] = 0.0
    labels = [(i, int(i % 3) - 1) for i in range(60)]
    dense = spark.createDataFrame(
        [(i, c, [float(v) for v in x[i]]) for i, c in labels], "id int, label int, x array<double>"
    )
    cells = [(i, f"t{j}", float(x[i, j])) for i in range(60) for j in range(5) if x[i, j]]
    weights = spark.createDataFrame(cells, "id int, term string, weight double")
    ids = spark.createDataFrame(labels, "id int, label int")
    params = B.term_parameters(B.fit_terms(weights, ids, "id"))
    sparse = {r["id"]: r for r in B.predict_terms(weights, ids, params, "id").collect()}
    want = B.predict(dense, B.fit(dense, "label", "x"), "x").collect()
    assert len(sparse) == 60
    for r in want:
        assert sparse[r["id"]]["y_pred"] == r["y_pred"]
        assert sparse[r["id"]]["score"] == pytest.approx(r["score"], abs=1e-8)


def test_kmeans_keeps_the_best_start(blobs, tmp_path):
    vectors = K.as_vectors(blobs, "x").cache()
    best = K.fit(vectors, k=3, starts=4, max_iter=30)
    single = [K.fit(vectors, k=3, starts=1, max_iter=30, seed=s) for s in range(4)]
    assert best.summary.trainingCost <= min(m.summary.trainingCost for m in single) + 1e-9
    centres = K.centre_table(best, blobs)
    by_model = {r["id"]: r["kmean_label"] for r in best.transform(vectors).collect()}
    by_rows = {r["id"]: r["kmean_label"] for r in K.assign(blobs, centres, "x").collect()}
    assert by_model == by_rows
    saved.save_kmeans(best, str(tmp_path / "km"))
    again = saved.load_kmeans(str(tmp_path / "km")).transform(vectors).collect()
    assert {r["id"]: r["kmean_label"] for r in again} == by_model
    moved = {r["cluster"]: r["centre"] for r in K.lloyd_step(blobs, centres, "x").collect()}
    for i, centre in enumerate(best.clusterCenters()):
        assert moved[i] == pytest.approx(list(centre), abs=1e-6)


def test_elbow_table(blobs):
    found = {r["k"]: r["wcss"] for r in K.wcss_sweep(blobs, "x", range(1, 4), starts=3, max_iter=30).collect()}
    x = np.array([r["x"] for r in blobs.collect()])
    assert found[1] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum(), rel=1e-9)
    assert found[1] > found[2] > found[3]


def test_all_runs_of_k_means_share_their_passes(blobs):
    runs = centres.fit_all(blobs, "x", [1, 2, 3, 4], starts=3, max_iter=50)
    assert [(r.k, r.start) for r in runs] == [(k, s) for k in (1, 2, 3, 4) for s in range(3)]
    x = np.array([r["x"] for r in blobs.collect()])
    for run in runs:
        # Each run ends in a fixed point of plain Lloyd steps.
        d = ((x[:, None] - run.centres[None]) ** 2).sum(2)
        nearest = d.argmin(1)
        assert run.wcss == pytest.approx(d.min(1).sum(), rel=1e-9)
        assert run.sizes.tolist() == np.bincount(nearest, minlength=run.k).tolist()
        means = [x[nearest == c].mean(0) if (nearest == c).any() else run.centres[c] for c in range(run.k)]
        assert np.allclose(run.centres, means, atol=1e-6)
    best = centres.best_per_k(runs)
    assert [r.k for r in best] == [1, 2, 3, 4]
    assert best[0].wcss == pytest.approx(((x - x.mean(0)) ** 2).sum(), rel=1e-9)
    assert best[0].wcss > best[1].wcss > best[2].wcss >= best[3].wcss
    again = centres.fit_all(blobs.repartition(20), "x", [3], starts=3, max_iter=50)
    assert sorted(r.wcss for r in again) == pytest.approx(sorted(r.wcss for r in runs if r.k == 3), rel=1e-9)


def test_k_means_without_rows_and_with_few_distinct_ones(spark):
    none = spark.createDataFrame([(None,)], "x array<double>")
    assert centres.fit_all(none, "x", [2]) == []
    same = spark.createDataFrame([([1.0, 2.0],)] * 4 + [(None,)], "x array<double>")
    (run,) = centres.fit_all(same, "x", [3], starts=1)
    assert run.wcss == 0 and run.sizes.sum() == 4


def test_k_means_on_terms_ends_in_a_fixed_point(spark):
    rng = np.random.default_rng(5)
    cells = [(d, f"t{t}", float(rng.integers(1, 4))) for d in range(60) for t in rng.choice(12, 4, replace=False) + 8 * (d % 3)]
    weights = spark.createDataFrame(cells, "doc_id long, term string, weight double")
    ids = spark.range(62).withColumnRenamed("id", "doc_id")  # two rows without terms
    found = centres.fit_terms(weights, ids, "doc_id", k=3)
    label = {r["doc_id"]: r["kmean_label"] for r in found.labels.collect()}
    assert sorted(label) == list(range(62)) and label[60] == label[61]
    terms = sorted({t for _, t, _ in cells})
    x = np.zeros((62, len(terms)))
    for d, t, w in cells:
        x[d, terms.index(t)] = w
    own = np.array([label[d] for d in range(62)])
    c = np.stack([x[own == k].mean(0) for k in range(3)])
    assert (((x[:, None] - c[None]) ** 2).sum(2).argmin(1) == own).all()
    value = {(r["cluster"], r["term"]): r["value"] for r in found.centres.collect()}
    assert all(value.get((k, t), 0.0) == pytest.approx(c[k, i]) for k in range(3) for i, t in enumerate(terms))


def test_k_means_on_sparse_rows_equals_the_one_on_terms(spark):
    rng = np.random.default_rng(6)
    cells = [(d, int(t), float(rng.integers(1, 4))) for d in range(90) for t in rng.choice(14, 5, replace=False) + 6 * (d % 3)]
    cells += [(4, 2, 1.5), (4, 9, 2.0), (None, 3, 1.0)]  # id 4 has two rows, and a row without an id
    weights = spark.createDataFrame([(d, f"t{t}", w) for d, t, w in cells], "doc_id long, term string, weight double")
    rows = [(d, [t for e, t, _ in cells[:450] if e == d], [w for e, _, w in cells[:450] if e == d]) for d in range(90)]
    rows += [(4, [2, 9], [1.5, 2.0]), (None, [3], [1.0]), (95, [], [])]
    rows = spark.createDataFrame(rows, "doc_id long, indices array<bigint>, values array<double>").repartition(5)
    ids = spark.createDataFrame([(d,) for d in [*range(92), 4, 7, 7, 95, None, None]], "doc_id long")
    for k, most in ((3, 100), (5, 100), (3, 0), (4, 1)):
        want = centres.fit_terms(weights, ids, "doc_id", k=k, max_iter=most)
        labels, iterations = centres.fit_sparse(rows, ids, "doc_id", 26, k=k, max_iter=most)
        assert sorted(map(str, labels.collect())) == sorted(map(str, want.labels.collect()))
        assert iterations == want.iterations
    nothing, _ = centres.fit_sparse(rows.where("doc_id = 95"), ids, "doc_id", 26)
    assert {r["kmean_label"] for r in nothing.collect()} == {None} and nothing.count() == 98


def test_pairwise_machine_separates_and_reloads(blobs, tmp_path):
    vectors = K.as_vectors(blobs, "x", "features").withColumn("label", F.col("label").cast("double"))
    model = svm.PairwiseSVC(C=1.0, maxIter=30).fit(vectors)
    predicted = {r["id"]: r["prediction"] for r in model.transform(vectors).collect()}
    right = sum(predicted[r["id"]] == r["label"] for r in vectors.collect())
    assert right >= 230
    model.save(str(tmp_path / "svm"), blobs)
    again = svm.PairwiseSVCModel.load(str(tmp_path / "svm"), blobs).transform(vectors)
    assert {r["id"]: r["prediction"] for r in again.collect()} == predicted


def test_rbf_machine_learns_what_a_linear_one_cannot(spark):
    rng = np.random.default_rng(1)
    angle, radius = rng.uniform(0, 2 * np.pi, 200), np.repeat([0.5, 2.0], 100)
    rows = [
        (i, float(i >= 100), [float(radius[i] * np.cos(angle[i])), float(radius[i] * np.sin(angle[i]))])
        for i in range(200)
    ]
    ring = K.as_vectors(spark.createDataFrame(rows, "id int, label double, x array<double>"), "x")

    def accuracy(machine):
        predicted = machine.fit(ring).transform(ring)
        pairs = predicted.select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
        return E.scores(pairs).first()["accuracy"]

    linear = svm.PairwiseSVC(kernel="linear", maxIter=20)
    rbf = svm.PairwiseSVC(kernel="rbf", gamma=1.0, C=10.0, fourierFeatures=200, maxIter=30)
    assert accuracy(rbf) > 0.97 > 0.8 > accuracy(linear)


def test_fourier_map_approximates_the_kernel(spark):
    directions, phases = svm.fourier_weights(3, 4000, 0.5, 0)
    x, y = [0.3, -0.2, 0.5], [0.1, 0.4, 0.0]
    rows = spark.createDataFrame([(0, x), (1, y)], "i int, x array<double>").coalesce(1)
    mapped = rows.select("i", svm.fourier_map(F.col("x"), directions, phases).alias("z")).orderBy("i")
    a, b = (np.array(r["z"]) for r in mapped.collect())
    exact = np.exp(-0.5 * sum((p - q) ** 2 for p, q in zip(x, y)))
    assert a @ b == pytest.approx(exact, abs=0.05)


def test_machines_of_a_grid_are_fitted_together(spark, blobs):
    rows = blobs.select("id", "label", "x", (F.col("id") % 7 == 0).alias("is_test"), (F.col("id") % 3).cast("int").alias("fold"))
    points = machines.linear_points([0.1, 1.0]) + machines.rbf_points([0.1, 1.0], [0.1])
    found = machines.grid_search(rows, "id", "x", "label", "fold", "is_test", 3, points, fourier_features=40)
    table = found.table.collect()
    assert len(table) == 4 and sum(r["is_best"] for r in table) == 1
    assert max(r["mean_score"] for r in table) == next(r["mean_score"] for r in table if r["is_best"]) > 0.9
    tested = found.tested.collect()
    assert sorted(r["id"] for r in tested) == [r["id"] for r in rows.where("is_test").orderBy("id").collect()]
    assert all((r["kernel"], r["C"], r["gamma"]) == tuple(found.best) for r in tested)
    by_fold = found.fold_predictions.groupBy("kernel", "C", "gamma", "id").count().collect()
    assert len(by_fold) == 4 * rows.where(~F.col("is_test")).count() and {r["count"] for r in by_fold} == {1}
    facts = found.machines.facts(spark).collect()
    n_pairs = len(found.machines.labels) * (len(found.machines.labels) - 1) // 2
    assert len(facts) == 4 * 4 * n_pairs
    assert all(0 < r["objective"] < r["objective_at_zero"] and r["iterations"] <= 100 for r in facts)


def test_a_machine_reaches_the_minimum(spark):
    """Against plain gradient steps on the same objective."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.7, 120) > 0.3, 1, -1)
    rows = spark.createDataFrame([(int(v), u.tolist()) for u, v in zip(x, y)] + [(None, [0.0] * 3), (1, None)], "y int, x array<double>")
    found = machines.train(rows, "x", "y", [machines.Point("linear", 2.0)], tol=1e-9)
    z, w = np.hstack([x, np.ones((120, 1))]), np.zeros(4)

    def objective(w):
        over = 1 - y * (z @ w)
        slope = np.clip(over / machines.SMOOTH, 0, 1)
        return (w[:3] @ w[:3]) / 2 + 2.0 * (slope * (over - slope * machines.SMOOTH / 2)).sum(), slope

    for _ in range(40_000):
        w = w - 5e-4 * (np.append(w[:3], 0) - 2.0 * z.T @ (objective(w)[1] * y))
    assert found.objective[0][0] == pytest.approx(objective(w)[0], rel=1e-5)
    assert objective(found.weights[0][0])[0] == pytest.approx(found.objective[0][0], rel=1e-9)
    again = machines.train(rows.repartition(40), "x", "y", [machines.Point("linear", 2.0)], tol=1e-9)
    assert again.objective[0][0] == pytest.approx(found.objective[0][0], rel=1e-6)


def test_machines_without_rows_or_with_one_class(spark):
    none = spark.createDataFrame([], "y int, x array<double>, h array<int>")
    found = machines.train(none, "x", "y", machines.linear_points([1.0]))
    assert found.facts(spark).collect() == []
    one = spark.createDataFrame([(5, [1.0], [0]), (5, [2.0], [0]), (None, [2.0], [0])], "y int, x array<double>, h array<int>")
    found = machines.train(one, "x", "y", machines.linear_points([1.0]))
    assert {(r["y_true"], r["y_pred"]) for r in found.predictions(one, "x", "y", "h").collect()} == {(5, 5), (None, 5)}


def test_presets_and_grids():
    assert svm.PRESET_RBF == {"kernel": "rbf", "C": 1000.0, "gamma": 0.001}
    assert len(svm.GRID_C) + len(svm.GRID_C) * len(svm.GRID_GAMMA) == 56


def test_all_models_assign_in_one_pass(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(700)] + [(700, None), (701, [1.0, None, 2.0]), (702, [1.0])]
    rows = spark.createDataFrame(rows, "id int, x array<double>").repartition(3)
    given = [(k, c, [0.5] * 3 if c > 1 else rng.normal(size=3).tolist()) for k in (2, 4) for c in range(k)]  # 2 and 3 are equal
    given = spark.createDataFrame(given, "k int, cluster int, centre array<double>")
    found = {(r["id"], r["k"]): r for r in K.assign(rows, given, "x", by="k").collect()}
    assert len(found) == 2 * 703
    for k in (2, 4):
        for want in K.assign(rows, given.where(F.col("k") == k).select("cluster", "centre"), "x").collect():
            r = found[want["id"], k]
            assert r["kmean_label"] == want["kmean_label"] and r["x"] == want["x"]
            assert r["dist2"] == (None if want["dist2"] is None else pytest.approx(want["dist2"], rel=1e-12))
    assert K.assign(rows, given.limit(0), "x", by="k").count() == 0


def test_rows_of_one_file_are_dealt_to_all_cores(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(2000, 4)).tolist()
    tasks, kept = [], centres.materialized
    monkeypatch.setattr(centres, "materialized", lambda df: tasks.append(kept(df).rdd.getNumPartitions()) or kept(df))
    (run,) = centres.fit_all(spark.createDataFrame([(v,) for v in x], "x array<double>").coalesce(1), "x", [4], starts=1, max_iter=3)
    assert tasks == [spark.sparkContext.defaultParallelism] and run.sizes.sum() == 2000


def test_nearest_centres_of_a_block_are_marked():
    rng = np.random.default_rng(9)
    x, given = rng.normal(size=(50, 3)), rng.normal(size=(7, 3))
    given[[2, 5]] = given[[1, 4]]  # equal centres: the lower one counts
    x[0] = given[1]
    runs, d = [(0, 3), (3, 7)], ((x[:, None] - given[None]) ** 2).sum(2)
    every = np.hstack([-2 * given, (given * given).sum(1)[:, None], np.ones((7, 1))])
    member, squares = centres._nearest(np.hstack([x, np.ones((50, 1)), (x * x).sum(1)[:, None]]), every, runs, np.empty((7, 64)))
    for run, (low, high) in enumerate(runs):
        assert (member[low:high].argmax(0) == d[:, low:high].argmin(1)).all() and (member[low:high].sum(0) == 1).all()
        assert squares[run] == pytest.approx(d[:, low:high].min(1).sum())


def test_settled_documents_are_left_out_of_passes(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.uniform(0, 1, (500, 2)), rng.uniform(0, 1, (500, 2)) + [40, 0]])
    cells = [(d, f"t{t}", float(x[d, t])) for d in range(1000) for t in (0, 1)]
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    rows = spark.createDataFrame([(d, [0, 1], x[d].tolist()) for d in range(1000)], "doc_id long, indices array<bigint>, values array<double>")
    want = centres.fit_terms(spark.createDataFrame(cells, "doc_id long, term string, weight double"), ids, "doc_id", k=6, max_iter=25)
    counts, kept = [], type(rows).persist

    def counted(df, *level):
        df = kept(df, *level)
        counts.append(df.count())
        return df

    monkeypatch.setattr(type(rows), "persist", counted)
    labels, iterations = centres.fit_sparse(rows, ids, "doc_id", 2, k=6, max_iter=25)
    assert sorted(labels.collect()) == sorted(want.labels.collect()) and iterations == want.iterations
    assert counts and max(counts) < 700


def test_labels_last_while_centres_move_within_their_limits():
    rng = np.random.default_rng(11)
    x, given = rng.normal(size=(300, 6)), rng.normal(size=(4, 6))
    shift, reach = rng.uniform(0.001, 0.02, 4), np.sqrt((x * x).sum(1))
    gain = 2 * shift * np.sqrt((given * given).sum(1)) + shift**2

    def likeness(c):
        return 2 * x @ c.T - (c * c).sum(1)

    label = likeness(given).argmax(1)
    times = centres._lasting(likeness(given), label, reach, shift, gain, 6)
    assert (times > 1).sum() > 100
    for _ in range(200):
        way = rng.normal(size=(4, 6))
        moved = given + way / np.sqrt((way * way).sum(1))[:, None] * shift[:, None]
        assert (likeness(moved).argmax(1) == label)[times > 1].all()


def test_words_are_counted_in_the_order_of_their_numbers(spark):
    terms = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "term string, df long")
    numbered = W.numbered_terms(terms, F.desc("df"))
    assert {r["term"]: r["index"] for r in numbered.collect()} == {"b": 0, "c": 1, "a": 2}
    docs = spark.createDataFrame([(1, ["a", "b", "z", "b"]), (2, []), (3, None), (4, ["z"]), (5, ["c", "b", "c"])], "id int, tokens array<string>")
    found = {r["id"]: (r["indices"], r["values"]) for r in W.sparse_features(docs.coalesce(1), "id", F.col("tokens"), numbered, 6).collect()}
    value = {w: np.log(6 / n) for w, n in (("a", 1), ("b", 3), ("c", 2))}
    assert {i: indices for i, (indices, _) in found.items()} == {1: [0, 2], 2: [], 3: [], 4: [], 5: [0, 1]}
    assert found[1][1] == pytest.approx([2 * value["b"], value["a"]]) and found[5][1] == pytest.approx([value["b"], 2 * value["c"]])
