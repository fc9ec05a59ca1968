"""Word weights, sentence scores and three-way classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.operators import dictionary as D
from opinion_spark.operators.lookup import lookup_join
from opinion_spark.operators.vocabulary import exploded, term_bag


def int_weight(weight: Column) -> Column:
    """Weight as an integer, truncated; 0 where it is missing or not a finite number."""
    number = weight.cast("string").try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(finite, number).otherwise(F.lit(0.0)).cast("int")


def last_weight_per_word(raw: DataFrame, order: Column) -> DataFrame:
    """``(word, weight)`` with the last row of each word in the given order."""
    last = F.max_by("weight", order)
    return raw.groupBy("word").agg(last.alias("weight"))


#: Tells rows of equal ids apart, so that each has its own result.
_ROW = "_row"


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn(_ROW, F.monotonically_increasing_id())


def _as_terms(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(F.col("word").alias("term"), int_weight(F.col("weight")).alias("weight"))


def word_weights(tokens: DataFrame, lexicon: DataFrame, spread_by: Column) -> DataFrame:
    """Add the integer ``weight`` of each ``term``, 0 for words the lexicon lacks."""
    joined = lookup_join(tokens, _as_terms(lexicon), "term", spread_by)
    return joined.withColumn("weight", F.coalesce("weight", F.lit(0)))


def _in_rows(lexicon: DataFrame, max_bytes: int) -> D.Dictionary | None:
    return D.dictionary(_as_terms(lexicon), "term", F.col("weight"), max_bytes)


def _sum(weights: Column) -> Column:
    """Sum of a list of weights, NULLs counting 0; 0 for no list."""
    total = F.aggregate(weights, F.lit(0).cast("bigint"), lambda acc, w: acc + F.coalesce(w, F.lit(0)))
    return F.coalesce(total, F.lit(0).cast("bigint"))


def _entries(terms: Column, weights: Column) -> Column:
    return F.zip_with(terms, weights, lambda t, w: F.struct(t.alias("term"), F.coalesce(w, F.lit(0)).alias("weight")))


def sentence_scores(
    df: DataFrame, id_col: str, tokens: Column, lexicon: DataFrame, keep: tuple[str, ...] = (), max_bytes: int = D.MAX_BYTES
) -> DataFrame:
    """``(id, *keep, score)``: sum of the word weights over every occurrence; 0 for documents without tokens.

    A lexicon of up to ``max_bytes`` is read inside the row, without a shuffle. Beyond, the tokens are joined: those of a document
    sit in one partition, so map-side aggregation leaves about one row per document to
    shuffle, and ``keep`` is meant for short columns.
    """
    words = _in_rows(lexicon, max_bytes)
    if words is not None:
        return df.select(id_col, *keep, _sum(words.values_of(tokens)).alias("score"))
    words = _numbered(df).select(_ROW, id_col, *keep, F.explode_outer(tokens).alias("term"))
    spread = F.struct(F.col(_ROW), F.col("term"))
    weighed = word_weights(words, lexicon, spread)
    return weighed.groupBy(_ROW, id_col, *keep).agg(F.sum("weight").alias("score")).drop(_ROW)


def word_scores(df: DataFrame, id_col: str, tokens: Column, lexicon: DataFrame, max_bytes: int = D.MAX_BYTES) -> DataFrame:
    """``(id, term, weight)``, one row per distinct word of a document."""
    words = _in_rows(lexicon, max_bytes)
    if words is not None:
        return _mapped(df, [id_col], tokens, words).select(id_col, F.inline("_entries"))
    return _word_scores(df, id_col, tokens, lexicon).select(id_col, "term", "weight")


def _mapped(df: DataFrame, keep: list[str], tokens: Column, words: D.Dictionary) -> DataFrame:
    """``keep`` and ``_entries``: the distinct words of each row with their weights, in word order."""
    terms = df.select(*keep, F.array_sort(F.array_distinct(tokens)).alias("_terms"))
    return terms.select(*keep, _entries(F.col("_terms"), words.values_of(F.col("_terms"))).alias("_entries"))


def _word_scores(df: DataFrame, id_col: str, tokens: Column, lexicon: DataFrame) -> DataFrame:
    words = exploded(_numbered(df), [_ROW, id_col], F.array_distinct(tokens), "term")
    return word_weights(words, lexicon, F.struct(F.col(_ROW), F.col("term")))


def word_score_map(df: DataFrame, id_col: str, tokens: Column, lexicon: DataFrame, max_bytes: int = D.MAX_BYTES) -> DataFrame:
    """``(id, classify_data)``: word -> weight map of each document that has words."""
    words = _in_rows(lexicon, max_bytes)
    if words is not None:
        mapped = _mapped(df, [id_col], tokens, words).where(F.size("_entries") > 0)
        return mapped.select(id_col, F.map_from_entries("_entries").alias("classify_data"))
    scored = _word_scores(df, id_col, tokens, lexicon)
    entries = F.sort_array(F.collect_list(F.struct("term", "weight")))
    return scored.groupBy(_ROW, id_col).agg(F.map_from_entries(entries).alias("classify_data")).drop(_ROW)


def sign_class(score: Column) -> Column:
    """Positive, zero, negative score -> 1, 0, -1."""
    return F.signum(score).cast("int")


def classify(
    df: DataFrame, id_col: str, tokens: Column, lexicon: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, *keep, score, classified)`` for every document."""
    scores = sentence_scores(df, id_col, tokens, lexicon, keep)
    return scores.withColumn("classified", sign_class(F.col("score")))


def classify_frame(df: DataFrame, id_col: str, tokens: Column, lexicon: DataFrame, max_bytes: int = D.MAX_BYTES) -> DataFrame:
    """The whole frame plus ``classify_data`` (word map) and ``classified``.

    Map and score come from the same pass over the distinct words of each document.
    """
    words = _in_rows(lexicon, max_bytes)
    if words is not None:
        bags = df.select("*", F.coalesce(term_bag(tokens), F.array().cast("array<struct<term:string,tf:bigint>>")).alias("_bag"))
        weights = words.values_of(F.col("_bag.term"))
        entries = _entries(F.col("_bag.term"), F.col("_weights"))
        score = _sum(F.zip_with("_weights", F.col("_bag.tf"), lambda w, n: w * n))
        return bags.select("*", weights.alias("_weights")).select(
            *df.columns, F.map_from_entries(F.array_sort(entries)).alias("classify_data"), sign_class(score).alias("classified")
        )
    numbered = _numbered(df)
    cells = numbered.select(_ROW, F.inline_outer(term_bag(tokens)))
    weighed = word_weights(cells, lexicon, F.struct(F.col(_ROW), F.col("term")))
    entry = F.when(F.col("term").isNotNull(), F.struct("term", "weight"))
    score = F.sum(F.col("weight") * F.coalesce("tf", F.lit(0)))
    scored = weighed.groupBy(_ROW).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("classify_data"),
        sign_class(score).alias("classified"),
    )
    return numbered.join(scored, _ROW, "left").drop(_ROW)
