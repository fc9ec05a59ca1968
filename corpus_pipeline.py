"""From raw documents to packed sequences: rules, near copies, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.llm import decontaminate, jaccard, packing, pii, quality_rules, store


def sound_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_documents(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle overlap."""
    return jaccard.keep_one_per_component(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii.redacted(docs, pii.trained(pii.training_windows(docs)))
    kinds = {f.name.lower(): f.dataType for f in docs.schema.fields}
    return clean.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else clean


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their ids, and their places in sequences."""
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("quality_rules", sound_documents),
    ("ngram_jaccard_join", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("best_fit_packing", sequences),
]

#: Trained span models and token ids are beyond SQL; the stages' operators are tested against brute force one by one.
ORACLE_SQL = None


#: Rows hold whole texts, sets or ids, so a batch of Spark's 10,000 is a large buffer in every task and in its worker.
ROWS_PER_BATCH = 1024


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing each one's rows before the next."""
    _small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store.landed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
