"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.llm.store import landed


def _in_tasks(rows: DataFrame, tasks: int | None) -> DataFrame:
    return rows.coalesce(tasks) if tasks else rows


def _large_star(edges: DataFrame, tasks: int | None) -> DataFrame:
    """Every neighbour above a node moves to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _in_tasks(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), tasks)
    moved = both.where(F.col("b") > F.col("a")).join(least, "a")
    return _in_tasks(moved.select(F.col("b").alias("a"), F.col("least").alias("b")), tasks)


def _small_star(edges: DataFrame, tasks: int | None) -> DataFrame:
    """A node and its neighbours below it move to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    down = _in_tasks(down.distinct(), tasks)
    least = _in_tasks(down.groupBy("a").agg(F.min("b").alias("least")), tasks)
    moved = (
        down.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    )
    return _in_tasks(moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct(), tasks)


def components(edges: DataFrame, edges_per_task: int | None = None) -> DataFrame:
    """Columns ``node`` and ``root`` (least node of its component) for every node of ``edges(a, b)``. ``edges_per_task``: how few
    edges are worth a task; None leaves that to the session.

    Large-star and small-star alternate until nothing changes, which takes about log(n) rounds. Only aggregates
    with map-side combining and equi-joins are used: no neighbourhood is gathered in one row.
    """
    edges = edges.select("a", "b").where(F.col("a") != F.col("b"))
    tasks = 1 + edges.count() // edges_per_task if edges_per_task else None
    current, seen = landed(_in_tasks(edges.distinct(), tasks)), None
    while True:
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        current = landed(_small_star(_large_star(current, tasks), tasks))
    stars = current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.unionByName(_in_tasks(stars.select(F.col("root").alias("node"), "root").distinct(), tasks))
