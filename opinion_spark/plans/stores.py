"""Files as analyses leave them behind: written to the shared folder, read back, and compared by SQL with what went in."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.operators import bayes as B
from opinion_spark.operators import lexicon as L
from opinion_spark.plans import evaluation
from opinion_spark.plans.relations import lexicon_small, six, table, texts, tokenised
from opinion_spark.runtime import shared_folder
from opinion_spark.sources import files
from opinion_spark.sources import models as saved

Query = Callable[[SparkSession, str], DataFrame]


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as quoted CSV files and back; NULL and empty text are one in CSV."""
    path = _path(spark)
    files.write_csv(texts(spark, sf_dir, "documents", "lang", "n_chars", "text"), path)
    back = files.read_csv(spark, path, "text string, n_chars bigint, lang string, doc_id bigint")
    return back.select("doc_id", "lang", "n_chars", F.coalesce("text", F.lit("")).alias("text"))


def token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token on a line of its own, read back as a word list and counted."""
    path = _path(spark)
    files.write_tokens(tokenised(spark, sf_dir, "doc_id", stop=True), F.col("tokens"), path)
    return files.read_words(spark, path).groupBy(F.col("word").alias("term")).agg(F.count("*").alias("tf"))


def class_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each lexicon class in a folder of its own, read back and counted."""
    path = _path(spark)
    docs = tokenised(spark, sf_dir, "doc_id")
    classes = L.classify(docs, "doc_id", F.col("tokens"), lexicon_small(spark), ("tokens",))
    files.write_group_tokens(classes, "classified", F.col("tokens"), path)
    words = spark.read.schema("value string, classified int").text(path)
    return words.groupBy("classified", F.col("value").alias("word")).agg(F.count("*").alias("n"))


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two runs in one table; the first is run again and replaces its own rows."""
    path = _path(spark)
    report = evaluation.classification_report(spark, sf_dir)
    for run_id in ("first", "second", "first"):
        files.append_results(report, path, run_id)
    return spark.read.parquet(path)


def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes fitted, saved, loaded again and scored."""
    path = _path(spark)
    rows = table(spark, sf_dir, "embeddings")
    saved.save_parameters(B.fit(rows, "label", "embedding"), path)
    scored = B.predict(rows, saved.load_parameters(spark, path), "embedding")
    return scored.select("vec_id", "y_pred", six(F.col("score")).alias("score"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (csv_round_trip, token_file, class_token_files, result_table, saved_model)}
