"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import compare
import pytest

import oracles
from opinion_spark import plans

QUERIES = plans.all_queries()
SQL = oracles.all_sql()
# Iterative fits: rows only, covered by test_models.
FITS = {
    "kmeans_fit",
    "wcss_sweep",
    "cluster_words",
    "svm_linear_fit",
    "svm_rbf_approx_fit",
    "svm_sweep",
    "svm_grid_search",
    "svm_grid_report",
    "svm_repeated_cv",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql_or_is_a_fit():
    assert set(QUERIES) - set(SQL) == FITS
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir)
    assert compare.difference(frame, con, SQL[name]) is None
    plan = compare.physical(frame)
    # Every pair of rows, or one Python call per row, would not survive large tables.
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan
