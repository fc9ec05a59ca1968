"""Scans, projections, encodings, stacking and attaching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.functions import encode as E
from opinion_spark.functions import text as T
from opinion_spark.operators import lexicon as L
from opinion_spark.operators import predictors as P
from opinion_spark.operators import reshape as R
from opinion_spark.plans.relations import table, texts
from opinion_spark.sources.datasets import DataSet, open_dataset
from opinion_spark.sources.files import tag_sources

Query = Callable[[SparkSession, str], DataFrame]

# Codes used by the queries below and their SQL.
EVENT_CODES = {"click": 0, "view": 1, "error": 2}
SOURCE_CODES = {"documents": 0, "benchmark": 1, "conversations": 2}
SEGMENT_DEVICES = {
    "HOUSEHOLD": "Twitter for iPhone",
    "MACHINERY": "Twitter for Android",
    "BUILDING": "Twitter Web App",
}
STATUS_CLASSES = {"F": "positive", "O": "negative", "P": "netral"}


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scan_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")


def _text_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text", "turn")
    return {"documents": docs, "benchmark": items, "conversations": turns}


def tagged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_sources(_text_sources(spark, sf_dir), SOURCE_CODES)


def lexicon_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(
        F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("word"),
        F.floor("c_acctbal").alias("weight"),
        "c_custkey",
    )
    return L.last_weight_per_word(raw, F.col("c_custkey"))


def named_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = {
        "classified-clean": DataSet(f"{sf_dir}/documents.parquet"),
        "cluster-labels": DataSet(f"{sf_dir}/embeddings.parquet", columns=("vec_id", "label")),
        "unavailable": None,
    }
    return open_dataset(spark, catalogue, "cluster-labels")


def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").drop("text", "n_chars")


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    name = F.col("o_orderstatus")
    for status, label in STATUS_CLASSES.items():
        name = F.when(F.col("o_orderstatus") == status, label).otherwise(name)
    named = orders.select("o_orderkey", name.alias("classified"), "o_orderpriority")
    return P.encode_classes(named, "classified")


def bool_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", E.flag(F.col("toxic") == 1).alias("verified"))


def category_encode_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", E.code_of(F.col("event_type"), EVENT_CODES, 3).alias("code"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.attach_by_key(docs, table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


def presence_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    return labelled.select("doc_id", E.presence_flag(F.col("quality")).alias("has_label"))


def nonempty_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = texts(spark, sf_dir, "documents", "text").select(
        "doc_id", F.regexp_extract("text", "#[A-Za-z0-9]+", 0).alias("hashtag")
    )
    return P.hashtag_flag(tags)


def fill_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = R.union_outer_columns(
        _labelled(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id")
    )
    return P.fill_zero(outer)


def filter_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.col("lang") == "de").select("doc_id", "lang", "source")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == 7)


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "text")
    return docs.select("doc_id", T.word_count(F.col("text")).alias("word_count"))


def predictor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and conversation turns as two crawls with the predictor columns."""
    none = F.lit(None)
    tag = F.regexp_extract("text", "#[A-Za-z0-9]+", 0)
    tag = F.when(tag != "", tag)
    docs = R.attach_by_key(
        texts(spark, sf_dir, "documents", "text", "n_chars", "source"),
        table(spark, sf_dir, "labels"),
        "doc_id",
        ["quality", "toxic"],
    ).select(
        F.col("doc_id").alias("id"),
        "text",
        tag.alias("hashtags"),
        F.col("n_chars").alias("followers_count"),
        F.col("quality").alias("friends_count"),
        F.col("toxic").alias("favourites_count"),
        none.cast("bigint").alias("favorite_count"),
        none.cast("bigint").alias("retweet_count"),
        (F.col("toxic") == 1).alias("verified"),
        F.when(F.col("source") == "src1", "Twitter Web App").otherwise(F.col("source")).alias("source"),
    )
    turns = texts(spark, sf_dir, "conversations", "text", "turn", "role").select(
        F.col("conv_id").alias("id"),
        "text",
        tag.alias("hashtags"),
        F.col("turn").alias("followers_count"),
        *[
            none.cast("bigint").alias(c)
            for c in ("friends_count", "favourites_count", "favorite_count", "retweet_count")
        ],
        (F.col("role") == "user").alias("verified"),
        F.when(F.col("role") == "user", "Twitter for iPhone").otherwise(none).alias("source"),
    )
    built = P.predictor_table([(docs, 0), (turns, 2)], keys=("id",))
    return built


def union_outer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.union_outer_columns(*_text_sources(spark, sf_dir).values())


def consolidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources, each scanned once, projected to common columns and stacked."""
    columns = {"documents": ("doc_id", "text"), "benchmark": ("item_id", "text"), "conversations": ("conv_id", "text"), "pages": ("page_id", "html")}
    parts = [
        table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(text).alias("text"), F.lit(name).alias("part"))
        for name, (key, text) in columns.items()
    ]
    return R.union_outer_columns(*parts)


def attach_columns_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels")
    return R.attach_by_position(docs, labels, ["quality", "toxic"], ["doc_id"], ["doc_id"])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scan_documents,
        scan_projected,
        tagged_sources,
        lexicon_dedup,
        named_dataset,
        drop_columns,
        label_encode,
        bool_encode,
        category_encode_other,
        presence_flag,
        nonempty_flag,
        fill_zero,
        filter_class,
        point_lookup,
        distinct_values,
        word_count,
        predictor_table,
        union_outer_columns,
        consolidate_sources,
        attach_columns_by_position,
    )
}
