"""Predictor table: encoded numeric columns per text, all sources stacked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from opinion_spark.functions.encode import (
    CLASS_CODES,
    class_code,
    device_code,
    flag,
    nonempty_flag,
    presence_flag,
)
from opinion_spark.functions.text import word_count

# The columns a predictor source must have.
PREDICTOR_INPUTS = [
    "text",
    "hashtags",
    "followers_count",
    "friends_count",
    "favourites_count",
    "favorite_count",
    "retweet_count",
    "verified",
    "source",
]


def encode_classes(df: DataFrame, label: str) -> DataFrame:
    """Class names -> codes: an integer label column, code strings in other text columns."""
    others = [
        f.name for f in df.schema if isinstance(f.dataType, S.StringType) and f.name != label
    ]
    codes = {name: str(code) for name, code in CLASS_CODES.items()}
    replaced = df.replace(codes, subset=others) if others else df
    return replaced.withColumn(label, class_code(F.col(label)))


def fill_zero(df: DataFrame) -> DataFrame:
    """Missing values -> 0 (the text '0' in string columns)."""
    return df.na.fill(0).na.fill("0")


def hashtag_flag(df: DataFrame, column: str = "hashtag") -> DataFrame:
    """Add ``<column>_vp``: 0 for an empty value, 1 otherwise."""
    return df.withColumn(f"{column}_vp", nonempty_flag(F.col(column)))


def predictors(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Encode one source: flags, device code, zeros for missing counts, word count."""
    counts = [c for c in PREDICTOR_INPUTS if c.endswith("_count")]
    return df.select(
        *keys,
        F.coalesce("text", F.lit("0")).alias("text"),
        presence_flag(F.col("hashtags")).alias("hashtags"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(flag(F.col("verified")), F.lit(0)).alias("verified"),
        device_code(F.col("source")).alias("source"),
        word_count(F.col("text")).alias("word_count"),
        F.lit("").alias("classified"),
    )


def predictor_table(
    sources: list[tuple[DataFrame, int]], keys: tuple[str, ...] = ()
) -> DataFrame:
    """Encode every ``(source, topic code)`` and stack them with the code in ``keyword``."""
    parts = [predictors(df, keys).withColumn("keyword", F.lit(code)) for df, code in sources]
    return reduce(DataFrame.unionByName, parts)
