"""Dictionary look-up joins that stay balanced when one key dominates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.runtime import MAX_BROADCAST_ROWS

# A key holding more than 1/SHARES of all rows is split over several tasks.
SHARES = 1024


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    spread_by: Column,
    how: str = "left",
    counts: DataFrame | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    table_size: int | None = None,
) -> DataFrame:
    """Join ``facts`` with a table that has one row per ``key``.

    The table is counted first, unless its size is given (as a number of entries, where a
    row holds several). Up to ``max_broadcast_rows`` it is broadcast and the
    facts are not shuffled. Beyond that, both sides are shuffled on ``(key, salt)``:
    the number of salts of a key is proportional to its share of the facts, so no task
    receives more than about ``1/SHARES`` of them, and only frequent keys are
    replicated. ``counts(key, rows)`` saves the counting pass when already known.
    """
    size = table.count() if table_size is None else table_size
    if size <= max_broadcast_rows:
        return facts.join(F.broadcast(table), key, how)
    return _salted_join(facts, table, key, spread_by, how, counts)


def _salted_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    spread_by: Column,
    how: str,
    counts: DataFrame | None,
) -> DataFrame:
    if counts is None:
        counts = facts.groupBy(key).agg(F.count("*").alias("rows"))
    share = F.col("rows") * SHARES / counts.select(F.sum("rows")).scalar()
    # Shares add up to SHARES, so at most SHARES keys can have a share above 1.
    frequent = F.broadcast(
        counts.where(F.col(key).isNotNull() & (share > 1)).select(
            key, F.ceil(share).cast("int").alias("_salts")
        )
    )
    salt = F.pmod(F.xxhash64(spread_by), F.coalesce("_salts", F.lit(1))).cast("int")
    # Keys that are NULL match nothing: spread them freely.
    free = F.pmod(F.xxhash64(spread_by), F.lit(SHARES)).cast("int")
    salted = (
        facts.join(frequent, key, "left")
        .withColumn("_salt", F.when(F.col(key).isNull(), free).otherwise(salt))
        .drop("_salts")
    )
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    replicated = (
        table.join(frequent, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    )
    return salted.join(replicated, [key, "_salt"], how).drop("_salt")
