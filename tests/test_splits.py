from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from opinion_spark.operators import reshape as R
from opinion_spark.operators import split as S


def smallest(ids, seed, k):
    ranked = sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    return set(ranked[:k])


def test_exact_train_test_split(spark):
    rows = spark.range(997)
    found = S.train_test_split(rows, "id", 0.1, 109).where("is_test").collect()
    assert {r["id"] for r in found} == smallest(range(997), 109, math.ceil(99.7))


def test_approximate_split_is_close(spark):
    share = S.train_test_split(spark.range(20000), "id", 0.1, exact=False).where("is_test").count()
    assert abs(share / 20000 - 0.1) < 0.01


def test_quotas(spark):
    rows = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(13)], "id int, label string")
    quotas = {r["label"]: r["quota"] for r in S.stratified_quotas(rows, "label").collect()}
    assert sum(quotas.values()) == math.ceil(1.3)
    large = spark.createDataFrame([("a", 6 * 10**12), ("b", 4 * 10**12)], "label string, n bigint")
    shared = {r["label"]: r["quota"] for r in S.class_quotas(large, "label").collect()}
    assert shared == {"a": 6 * 10**11, "b": 4 * 10**11}


@pytest.mark.parametrize("sizes", [{-1: 58, 0: 341, 1: 120}, {0: 1, 1: 1999}])
def test_stratified_splits(spark, sizes):
    labels = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    rows = spark.createDataFrame(labels, "id int, label int")
    n, splits = len(labels), 4
    train = n - math.ceil(0.1 * n)
    base = {c: k * train // n for c, k in sizes.items()}
    spare = train - sum(base.values())
    order = sorted(sizes, key=lambda c: (-(sizes[c] * train % n), c))
    quota = {c: sizes[c] - base[c] - (order.index(c) < spare) for c in sizes}
    found = defaultdict(set)
    marked = S.stratified_shuffle_split(rows, "id", "label", splits).collect()
    assert len(marked) == n * splits
    for r in marked:
        if r["is_test"]:
            found[r["split"], r["label"]].add(r["id"])
    for split in range(1, splits + 1):
        for c in sizes:
            ids = [i for i, label in labels if label == c]
            assert found[split, c] == smallest(ids, split, quota[c])
    cuts = S.stratified_cuts(rows, "id", "label", splits)
    listed = S.with_test_splits(rows, cuts, "id", "label").collect()
    again = {(s, r["label"], r["id"]) for r in listed for s in r["test_splits"]}
    assert again == {(s, c, i) for (s, c), ids in found.items() for i in ids}


def test_repeated_ids_do_not_break_the_split(spark):
    rows = spark.range(300).select((F.col("id") % 2 * F.col("id")).alias("id"))
    marked = S.train_test_split(rows, "id", 0.1)
    sides = marked.groupBy("id").agg(F.count_distinct("is_test").alias("k"))
    assert sides.agg(F.max("k")).first()[0] == 1
    assert marked.where("is_test").count() >= 30


def test_contiguous_folds(spark):
    found = S.kfold_contiguous(spark.range(13).repartition(4), "id", folds=10).orderBy("id").collect()
    sizes = Counter(r["fold"] for r in found)
    assert [sizes[f] for f in range(10)] == [2, 2, 2, 1, 1, 1, 1, 1, 1, 1]
    assert [r["fold"] for r in found] == sorted(r["fold"] for r in found)
    few = S.kfold_contiguous(spark.range(3), "id", folds=10).orderBy("id").collect()
    assert [r["fold"] for r in few] == [0, 1, 2]


def test_ordinals_follow_the_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("k"))
    ranked = R.with_ordinal(rows.repartition(7), "k", "v")
    assert ranked.where("ordinal <> v").count() == 0 and ranked.count() == 5000


def test_attach_by_position(spark):
    left = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    right = spark.createDataFrame([(20, "y"), (10, "x")], "o int, v string")
    found = R.attach_by_position(left, right, ["v"], ["k"], ["o"]).orderBy("k").collect()
    assert [(r["k"], r["v"]) for r in found] == [("a", "x"), ("b", "y"), ("c", None)]


def test_union_keeps_repeats_and_fills_columns(spark):
    a = spark.createDataFrame([(1, "x")], "i int, a string")
    b = spark.createDataFrame([(1, "y"), (1, "y")], "i int, b string")
    found = R.union_outer_columns(a, b)
    assert found.columns == ["i", "a", "b"] and found.count() == 3


def test_rows_without_a_label_are_a_class_of_their_own(spark):
    rows = spark.createDataFrame([(i, 1 if i % 2 else None) for i in range(100)], "id long, label int")
    marked = S.stratified_shuffle_split(rows, "id", "label", 2, 0.1).collect()
    assert len(marked) == 200
    for split in (1, 2):
        tested = [r["label"] for r in marked if r["split"] == split and r["is_test"]]
        assert sorted(map(str, tested)) == ["1"] * 5 + ["None"] * 5
