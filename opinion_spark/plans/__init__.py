"""Flows that combine the operators, as run by ``__spark_entry__.py`` and ``bench.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from opinion_spark.plans import corpus, evaluation, models, stores, tables, text

    found = {}
    for module in (tables, text, corpus, models, evaluation, stores):
        found.update(module.QUERIES)
    return found
