"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in single-process local mode without it, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def landed(df: DataFrame) -> DataFrame:
    """Write as Parquet to the shared folder and read back: computed once, short lineage,
    nothing held by an executor. The files are kept until the job ends, so they are compressed well."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column, text: Column) -> Column:
    """A row's key where ``doc_id`` may be NULL or repeated; equal only for equal rows (64 bits)."""
    return F.xxhash64(doc_id, text)


def renamed_apart(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name, one that no column of ``df`` has (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        free = name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out[name] = free
    return out
