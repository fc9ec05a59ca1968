"""Readers and writers for the flat files an analysis starts from and leaves behind."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from opinion_spark.operators.lexicon import last_weight_per_word
from opinion_spark.operators.vocabulary import exploded

# Column names of the files.
CRAWL_SCHEMA = "status_id string, created_at string, screen_name string, text string"
PREDICTOR_SCHEMA = (
    "text string, hashtags string, followers_count bigint, friends_count bigint, "
    "favourites_count bigint, favorite_count bigint, retweet_count bigint, "
    "verified boolean, source string"
)
LEXICON_SCHEMA = "word string, weight string"

# Topic code of each crawl.
TOPIC_CODES = {
    "ruu.minol": 0,
    "ruu.minol2": 0,
    "ruu.minuman.beralkohol": 2,
    "ruu.minuman.beralkohol2": 2,
    "ruu.miras": 1,
    "ruu.miras2": 1,
}

_CSV = {"header": True, "quote": '"', "escape": '"'}


def _typed(field: S.StructField) -> Column:
    """Text from a file as the wanted type; NULL where it does not fit."""
    text = F.col(f"`{field.name}`")
    value = text.try_cast(field.dataType)
    if isinstance(field.dataType, S.IntegralType):
        # Counts in columns with gaps are written as 12.0.
        value = F.coalesce(value, text.try_cast("double").try_cast(field.dataType))
    return value.alias(field.name)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: str | S.StructType,
    columns: list[str] | None = None,
) -> DataFrame:
    """CSV with a header row; quoted fields may hold line breaks and doubled quotes.

    Columns are found by header name, in any order and in every file; columns outside the schema (such as
    written row indexes) are not read, and a file without one of them is an error. Files with equal headers are
    read together. A ``multiLine`` file is read whole by one task, which bounds its size: pass many files rather than one
    large one, or ``land`` them once as Parquet.
    """
    reader = spark.read.options(**_CSV, multiLine=True, lineSep="\n")
    found = spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()
    by_header: dict[tuple[str, ...], list[str]] = {}
    for row in found:
        by_header.setdefault(tuple(reader.csv(row["path"]).columns), []).append(row["path"])
    fields = S.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = [f for f in fields if columns is None or f.name in columns]
    parts = [reader.csv(paths).select(*[_typed(f) for f in wanted]) for paths in by_header.values()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], S.StructType(wanted))


def land(df: DataFrame, path: str) -> DataFrame:
    """Write once as Parquet and read back: splittable, column-pruned, filterable."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tag_sources(sources: Mapping[str, DataFrame], codes: Mapping[str, int]) -> DataFrame:
    """Stack named frames; ``source_name`` and the topic code ``keyword`` tell them apart."""
    parts = [
        df.withColumns({"source_name": F.lit(name), "keyword": F.lit(codes[name])})
        for name, df in sources.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_tagged_csv(
    spark: SparkSession,
    files: Mapping[str, str],
    schema: str,
    codes: Mapping[str, int] = TOPIC_CODES,
    columns: list[str] | None = None,
) -> DataFrame:
    """Several crawls, each with the topic code that belongs to its name."""
    frames = {name: read_csv(spark, path, schema, columns) for name, path in files.items()}
    return tag_sources(frames, codes)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``(word, weight)`` from CSV; of a repeated word the last row counts."""
    raw = read_csv(spark, path, LEXICON_SCHEMA).withColumn(
        "_row", F.struct(F.input_file_name(), F.monotonically_increasing_id())
    )
    return last_weight_per_word(raw, F.col("_row"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A text list, one word per line: ``(word)``."""
    return spark.read.text(path).select(F.col("value").alias("word"))


def _flat(column: str, kind: S.DataType) -> Column:
    if isinstance(kind, (S.MapType, S.ArrayType, S.StructType)):
        return F.to_json(column).alias(column)
    return F.col(column)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file per task, with header; nested columns as JSON text."""
    flat = df.select(*[_flat(f.name, f.dataType) for f in df.schema])
    flat.write.mode(mode).options(**_CSV).csv(path)


def write_tokens(df: DataFrame, tokens: Column, path: str) -> None:
    """Every token on its own line."""
    exploded(df, [], tokens, "value").write.mode("overwrite").text(path)


def write_group_tokens(df: DataFrame, group: str, tokens: Column, path: str) -> None:
    """Every token on its own line, one folder per class or cluster, in a single job.

    Each task writes to the folders itself; rows are not moved, so a dominant class is
    spread over all tasks.
    """
    words = exploded(df, [group], tokens, "value")
    words.write.mode("overwrite").partitionBy(group).text(path)


def append_results(df: DataFrame, path: str, run_id: str) -> None:
    """The evaluation rows of one run in a result table partitioned by run.

    A rerun replaces the rows of its own ``run_id`` and leaves all other runs as they are; one without rows changes nothing.
    """
    rows = df.withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
