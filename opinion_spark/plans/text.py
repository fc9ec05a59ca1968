"""Cleaning, tokenising, preprocessing and lexicon sentiment over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.functions import text as T
from opinion_spark.operators import lexicon as L
from opinion_spark.operators import vocabulary as V
from opinion_spark.plans.relations import (
    STOPWORDS,
    lexicon_hashed,
    lexicon_small,
    stopword_table,
    table,
    texts,
    tokenised,
)
from opinion_spark.runtime import materialized

Query = Callable[[SparkSession, str], DataFrame]


def _per_document(expression: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = texts(spark, sf_dir, "documents", "text")
        return docs.select("doc_id", expression(F.col("text")).alias("out"))

    return run


def _joined(expression: Callable[[Column], Column]) -> Query:
    return _per_document(lambda c: F.array_join(expression(c), "|"))


def strip_mentions_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "pages", "url", "html")
    text = F.concat_ws(" ", "url", "html")
    return pages.select("page_id", T.strip_mentions_urls(text).alias("out"))


def strip_url_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.strip_url_schemes(F.col("url")).alias("out"))


def clean_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "pages", "url", "html")
    text = F.concat_ws(" ", "url", "html")
    return pages.select("page_id", T.clean_text(text).alias("out"))


def stopword_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = texts(spark, sf_dir, "documents", "text").select(
        T.drop_stopwords(T.drop_short(T.clean_words(T.clean_text(F.col("text")))), STOPWORDS).alias(
            "tokens"
        )
    )
    return V.term_frequency(words, F.col("tokens"))


def stopword_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenised(spark, sf_dir, "doc_id")
    tokens = V.positioned_tokens(docs, "doc_id", F.col("tokens"))
    kept = V.stopword_anti_join(tokens, stopword_table(spark))
    return kept.groupBy("term").agg(F.count("*").alias("tf"))


def strip_ending(words: pd.Series) -> pd.Series:
    """A stand-in for a stemmer: three endings of long words."""
    stripped = words.str.replace(r"(tion|ing|ment)$", "", regex=True)
    return words.where(words.str.len() <= 6, stripped)


def _stems(docs: DataFrame) -> DataFrame:
    return V.build_stem_table(V.vocabulary(docs, F.col("tokens")), strip_ending)


def vocab_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stems(tokenised(spark, sf_dir))


def stem_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenised(spark, sf_dir, "doc_id")
    stems = V.stem_arrays(F.col("tokens"), strip_ending)
    return docs.select("doc_id", F.array_join(stems, " ").alias("preprocessed"))


def stage_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "text")
    stages = V.stage_detail(docs, "text", STOPWORDS)
    return stages.select(
        "doc_id",
        "text",
        "cleaning",
        F.array_join("tokenized", "|").alias("tokenized"),
        "folding",
        F.array_join("tokens", "|").alias("tokens"),
    )


def preprocess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "lang", "text")
    return V.preprocess_documents(docs, "text", STOPWORDS).drop("text")


def word_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = V.vocabulary(tokenised(spark, sf_dir), F.col("tokens"))
    return L.word_weights(terms, lexicon_small(spark), F.col("term"))


def sentence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenised(spark, sf_dir, "doc_id")
    lexicon = materialized(lexicon_hashed(docs))
    return L.sentence_scores(docs, "doc_id", F.col("tokens"), lexicon)


def sentence_score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = texts(spark, sf_dir, "conversations", "text")
    words = turns.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), T.split_words(F.col("text")).alias("tokens")
    )
    return L.sentence_scores(words, "id", F.col("tokens"), lexicon_small(spark))


def word_score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenised(spark, sf_dir, "doc_id")
    maps = L.word_score_map(docs, "doc_id", F.col("tokens"), lexicon_small(spark))
    return maps.select("doc_id", F.explode("classify_data").alias("term", "weight"))


def document_classes(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    docs = tokenised(spark, sf_dir, "doc_id", *keep)
    return L.classify(docs, "doc_id", F.col("tokens"), lexicon_small(spark), keep)


def lexicon_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: raw text to sentiment classes, counted by language."""
    classes = document_classes(spark, sf_dir, "lang")
    return classes.groupBy("lang", "classified").agg(F.count("*").alias("n"))


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenised(spark, sf_dir, "doc_id", "source")
    framed = L.classify_frame(docs, "doc_id", F.col("tokens"), lexicon_small(spark))
    words = F.size("classify_data").alias("n_words")
    return framed.select("doc_id", "source", words, "classified")


QUERIES: dict[str, Query] = {
    "clean_escapes": _per_document(T.clean_escapes),
    "ascii_replace": _per_document(T.ascii_replace),
    "strip_mentions_urls": strip_mentions_urls,
    "strip_url_schemes": strip_url_schemes,
    "remove_numbers": _per_document(T.remove_numbers),
    "remove_punctuation": _per_document(T.remove_punctuation),
    "trim_whitespace": _per_document(lambda c: T.trim_whitespace(F.concat(F.lit(" \t"), c, F.lit("\n ")))),
    "collapse_whitespace": _per_document(T.collapse_whitespace),
    "clean_text": _per_document(T.clean_text),
    "clean_text_pages": clean_text_pages,
    "tokenize_words": _joined(T.tokenize_words),
    "sentence_split": _joined(T.sentence_split),
    "split_words": _joined(T.split_words),
    "short_token_filter": _joined(lambda c: T.drop_short(T.split_words(c))),
    "clean_tokens": _joined(lambda c: T.clean_tokens(c, STOPWORDS)),
    "clean_sentences": _joined(T.clean_sentences),
    "stopword_substring": stopword_substring,
    "stopword_anti_join": stopword_anti_join,
    "vocab_stem": vocab_stem,
    "stem_documents": stem_documents,
    "stage_detail": stage_detail,
    "preprocess_documents": preprocess_documents,
    "word_weight": word_weight,
    "sentence_score": sentence_score,
    "sentence_score_text": sentence_score_text,
    "word_score_map": word_score_map,
    "lexicon_classify": lexicon_classify,
    "classify_documents": classify_documents,
}
