"""Tables and fixed relations the flows run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.functions import text as T
from opinion_spark.operators import vocabulary as V

# Fixed values shared with the equivalent SQL.
STOPWORDS = ["the", "and", "of", "to", "der", "die", "und", "de", "la", "le", "el", "en"]
LEXICON = [
    ("the", 1),
    ("and", -1),
    ("that", 2),
    ("der", 1),
    ("und", -2),
    ("de", 1),
    ("la", -1),
    ("le", 2),
    ("en", -3),
]
# The vocabulary of the wide matrix is named by its caller: one column per term.
MATRIX_TERMS = ["and", "de", "der", "en", "la", "le", "of", "the", "und", "with"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Key columns of the text tables.
TEXT_KEYS = {
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
    "benchmark": ["item_id"],
}


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a text table and its keys."""
    return table(spark, sf_dir, name).select(*dict.fromkeys([*TEXT_KEYS[name], *columns]))


def lexicon_small(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, weight int")


def lexicon_hashed(docs: DataFrame) -> DataFrame:
    """A lexicon as large as the vocabulary: weight ``length % 11 - 5`` from 4 letters on."""
    words = V.vocabulary(docs, F.col("tokens")).where(F.char_length("term") >= 4)
    weight = F.char_length("term") % 11 - 5
    return words.select(F.col("term").alias("word"), weight.alias("weight"))


def stopword_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOPWORDS], "word string")


def tokenised(
    spark: SparkSession, sf_dir: str, *keep: str, stop: bool = False, name: str = "documents"
) -> DataFrame:
    """``(*keep, tokens)`` of a text table; ``stop`` drops the stop words."""
    tokens = T.clean_tokens(F.col("text"), STOPWORDS if stop else ())
    return texts(spark, sf_dir, name, *keep, "text").select(*keep, tokens.alias("tokens"))


def significant(value) -> F.Column:
    """Round to seven significant digits, whatever the magnitude."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-9)))))
    return F.round(value / scale, 6) + F.lit(0.0)


def six(value) -> F.Column:
    """Round to 6 places, without negative zero."""
    return F.round(value, 6) + F.lit(0.0)
