"""What the physical plans must and must not contain."""

from __future__ import annotations

from compare import physical
from pyspark.sql import functions as F

from opinion_spark import plans
from opinion_spark.operators import lexicon as L
from opinion_spark.operators import vocabulary as V
from opinion_spark.operators import weights as W
from opinion_spark.plans.relations import lexicon_small, texts, tokenised

QUERIES = plans.all_queries()


def test_flagship_plan(spark, sf_dir):
    plan = physical(QUERIES["lexicon_classify"](spark, sf_dir))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1  # by class, after partial counts
    assert "ReadSchema: struct<text:string,lang:string>" in plan


def test_cleaning_is_evaluated_once(spark, sf_dir):
    docs = tokenised(spark, sf_dir, "doc_id")
    for frame in (
        V.term_frequency(docs, F.col("tokens")),
        V.term_counts(docs, ["doc_id"], F.col("tokens")),
        V.positioned_tokens(docs, "doc_id", F.col("tokens")),
    ):
        assert physical(frame).count("regexp_extract_all") == 1


def test_term_counts_do_not_shuffle(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "text").select(
        "doc_id", F.split("text", " ").alias("tokens")
    )
    before = physical(docs).count("Exchange")
    assert physical(V.term_counts(docs, ["doc_id"], F.col("tokens"))).count("Exchange") == before


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = physical(QUERIES["point_lookup"](spark, sf_dir))
    assert "EqualTo(doc_id,7)" in plan
    plan = physical(QUERIES["scan_projected"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan


def test_dictionaries_are_read_inside_the_row(spark, sf_dir):
    docs, lexicon = tokenised(spark, sf_dir, "doc_id"), lexicon_small(spark)
    terms = spark.createDataFrame([("the", 5, 0), ("of", 3, 1)], "term string, df long, index long")
    tokens = F.col("tokens")
    for frame in (
        L.sentence_scores(docs, "doc_id", tokens, lexicon),
        L.word_score_map(docs, "doc_id", tokens, lexicon),
        L.classify_frame(docs, "doc_id", tokens, lexicon),
        W.sparse_features(docs, "doc_id", tokens, terms, 10),
    ):
        plan = physical(frame)
        assert "Exchange" not in plan and "Join" not in plan and plan.count("regexp_extract_all") == 1
