"""The registered queries of this package: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opinion_spark.llm import chat, chosen_path, classifier, decontaminate, jaccard, licenses, manifest, packing, phrases, pii, quality_rules, substrings, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judged(_table(spark, sf_dir, "documents")).select(*names)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.found(docs, pii.trained(pii.training_windows(docs)))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sample = classifier.labelled_sample(docs, _table(spark, sf_dir, "labels"))
    return classifier.scored(docs, classifier.trained(sample, label="label"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(_table(spark, sf_dir, "conversations"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_repeats(_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proofs(manifest.document_manifest(_table(spark, sf_dir, "documents")))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.deduplicated(_table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


_ALL = [
    op1_best_fit_packing,
    op2_license_scan,
    op3_token_counts,
    op4_quality_rules,
    op5_pii,
    op6_quality_classifier,
    op7_chat_formatting,
    op8_substring_dedup,
    op9_benchmark_decontamination,
    op10_ngram_jaccard_join,
    op11_merkle_manifest,
    op12_minhash_near_dedup,
    op13_phrase_collocations,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {query.__name__: query for query in _ALL}
