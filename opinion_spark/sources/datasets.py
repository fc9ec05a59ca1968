"""Data sets opened by logical name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from opinion_spark.sources.files import read_csv


@dataclass(frozen=True)
class DataSet:
    """Where a data set lives and which of its columns are read."""

    path: str
    format: str = "parquet"
    schema: str | None = None
    columns: tuple[str, ...] = ()

    def open(self, spark: SparkSession) -> DataFrame:
        if self.format == "csv":
            if self.schema is None:
                raise ValueError("a CSV data set needs a schema")
            return read_csv(spark, self.path, self.schema, list(self.columns) or None)
        reader = spark.read.format(self.format)
        table = (reader.schema(self.schema) if self.schema else reader).load(self.path)
        return table.select(*self.columns) if self.columns else table


def open_dataset(
    spark: SparkSession, catalogue: Mapping[str, DataSet | None], name: str
) -> DataFrame | None:
    """The frame behind a name; None for a name without data."""
    if name not in catalogue:
        raise KeyError(f"unknown data set: {name}")
    entry = catalogue[name]
    return None if entry is None else entry.open(spark)


def register_views(spark: SparkSession, catalogue: Mapping[str, DataSet | None]) -> None:
    """Make every named data set available to ``spark.sql``; dots become underscores."""
    for name, entry in catalogue.items():
        if entry is not None:
            view = "".join(c if c.isalnum() else "_" for c in name)
            entry.open(spark).createOrReplaceTempView(view)
