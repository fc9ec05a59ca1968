"""Corpus statistics, TF-IDF, matrices and word clouds over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.functions import text as T
from opinion_spark.operators import clouds as C
from opinion_spark.operators import lexicon as L
from opinion_spark.operators import vocabulary as V
from opinion_spark.operators import weights as W
from opinion_spark.plans import models as M
from opinion_spark.plans.relations import MATRIX_TERMS, lexicon_small, six, texts, tokenised
from opinion_spark.runtime import landed, materialized

Query = Callable[[SparkSession, str], DataFrame]


def global_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenised(spark, sf_dir, "doc_id", stop=True)
    return V.global_words(docs, ["doc_id"], F.col("tokens"))


def global_words_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored, space-joined form back to terms, counted."""
    docs = texts(spark, sf_dir, "documents", "text")
    stored = V.preprocess_documents(docs)
    return V.term_frequency(stored, V.split_stored(F.col("preprocessed")))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.term_frequency(tokenised(spark, sf_dir, stop=True), F.col("tokens"))


def char_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.char_frequency(texts(spark, sf_dir, "documents", "text"), F.col("text"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vocabulary(tokenised(spark, sf_dir, stop=True), F.col("tokens"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of the conversations, counted in the documents."""
    turns = tokenised(spark, sf_dir, name="conversations")
    terms = materialized(V.vocabulary(turns, F.col("tokens")))
    return V.document_frequency(tokenised(spark, sf_dir), F.col("tokens"), terms)


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenised(spark, sf_dir, "doc_id")
    n = docs.select(F.count("*")).scalar()
    frequencies = V.document_frequency(docs, F.col("tokens"))
    return W.idf_table(frequencies, n).withColumn("idf", six(F.col("idf")))


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenised(spark, sf_dir, "doc_id", stop=True)
    weights = W.tfidf(docs, "doc_id", F.col("tokens"))
    return weights.withColumn("weight", six(F.col("weight")))


def tf_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every term of the conversations' vocabulary in the documents."""
    terms = materialized(V.vocabulary(tokenised(spark, sf_dir, name="conversations"), F.col("tokens")))
    return W.tf_per_document(tokenised(spark, sf_dir, "doc_id"), "doc_id", F.col("tokens"), terms)


def _frequencies(docs: DataFrame) -> tuple[DataFrame, int]:
    return materialized(V.document_frequency(docs, F.col("tokens"))), docs.count()


def doc_term_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide TF-IDF matrix over a given vocabulary."""
    docs = tokenised(spark, sf_dir, "doc_id")
    terms = spark.createDataFrame([(t,) for t in MATRIX_TERMS], "term string")
    counted = V.document_frequency(docs, F.col("tokens"), terms)
    idfs = {r["term"]: r["idf"] for r in W.idf_table(counted, docs.count()).collect()}
    vectors = W.term_vectors(docs, "tokens", MATRIX_TERMS, [idfs[t] for t in MATRIX_TERMS])
    wide = W.doc_term_columns(vectors, ["doc_id"], "features", MATRIX_TERMS)
    return wide.select("doc_id", *[six(F.col(f"t_{t}")).alias(f"t_{t}") for t in MATRIX_TERMS])


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse TF-IDF rows over all terms: filled cells, last index, sum, and sum weighted by the index."""
    docs = tokenised(spark, sf_dir, "doc_id")
    frequencies, n = _frequencies(docs)
    rows = W.sparse_features(docs, "doc_id", F.col("tokens"), W.numbered_terms(frequencies), n)

    def total(values: F.Column) -> F.Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    placed = F.zip_with("indices", "values", lambda i, v: (i + 1) * v / 1000)
    return rows.select(
        "doc_id",
        F.size(F.filter("values", lambda v: v != 0)).cast("long").alias("n_terms"),
        F.array_max("indices").alias("last_index"),
        six(total(F.col("values"))).alias("weight_sum"),
        six(total(placed)).alias("placed_sum"),
    )


def class_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per lexicon class."""
    docs = tokenised(spark, sf_dir, "doc_id")
    classes = L.classify(docs, "doc_id", F.col("tokens"), lexicon_small(spark), ("tokens",))
    return C.group_word_counts(classes, "classified", F.col("tokens"))


def cluster_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per cluster of the documents' own TF-IDF."""
    # Texts are cleaned once; they are shuffled for the join, not their tokens: an array takes several times the text's bytes.
    docs = landed(texts(spark, sf_dir, "documents", "text").select("doc_id", T.clean_text(F.col("text")).alias("clean")))
    tokens = T.clean_tokens(F.col("clean"), cleaned=True)
    clusters = M.term_clusters(spark, sf_dir, docs.select("doc_id", tokens.alias("tokens")))
    return C.group_word_counts(docs.join(clusters, "doc_id"), "kmean_label", tokens)


def predicted_class_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per class that naive Bayes predicts from the documents' own TF-IDF."""
    docs = tokenised(spark, sf_dir, "doc_id")
    predicted = M.term_predictions(spark, sf_dir).select("doc_id", "y_pred")
    return C.group_word_counts(docs.join(predicted, "doc_id"), "y_pred", F.col("tokens"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        global_words,
        global_words_stored,
        term_frequency,
        char_frequency,
        vocabulary,
        document_frequency,
        idf,
        tfidf,
        tf_per_document,
        doc_term_pivot,
        feature_vectors,
        class_words,
        cluster_words,
        predicted_class_words,
    )
}
