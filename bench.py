"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline list below)

Every query runs once to warm up and is then timed over a full run whose result is
consumed by the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from opinion_spark import plans

HEADLINE = [
    "clean_text",
    "clean_text_pages",
    "tokenize_words",
    "preprocess_documents",
    "stem_documents",
    "sentence_score",
    "word_score_map",
    "lexicon_classify",
    "global_words",
    "term_frequency",
    "char_frequency",
    "document_frequency",
    "idf",
    "tfidf",
    "tf_per_document",
    "doc_term_pivot",
    "feature_vectors",
    "class_words",
    "predictor_table",
    "consolidate_sources",
    "attach_columns_by_position",
    "train_test_split",
    "stratified_shuffle_split",
    "kfold_contiguous",
    "kmeans_assign",
    "kmeans_lloyd_step",
    "gnb_fit",
    "gnb_predict",
    "gnb_predict_terms",
    "nb_repeated_cv",
    "rff_transform",
    "classification_report",
    "model_report",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, query, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    found = plans.all_queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(found) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    seconds = {}
    for name in names:
        run(spark, found[name], sf_dir)
        seconds[name] = round(run(spark, found[name], sf_dir), 3)
        spark.catalog.clearCache()
    spark.stop()
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
