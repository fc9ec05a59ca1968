"""Token pipelines, vocabulary-level decisions and corpus counts.

A document is one row, so everything that concerns a single document (its tokens, its
term counts) is computed inside the row. The first shuffle of a corpus statistic is
keyed by term and carries partial counts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions import text as T
from opinion_spark.functions.vector import let
from opinion_spark.operators.lookup import lookup_join
from opinion_spark.runtime import MAX_BROADCAST_ROWS


def split_stored(preprocessed: Column) -> Column:
    """Tokens of the stored, space-joined form; none for NULL or empty text."""
    return F.when(preprocessed != "", F.split(preprocessed, " "))


def preprocess_documents(
    df: DataFrame, text: str = "text", stopwords: Iterable[str] = (), mode: str = "substring"
) -> DataFrame:
    """Add ``preprocessed``: the clean tokens of ``text`` joined by one space."""
    tokens = T.clean_tokens(F.col(text), stopwords, mode)
    return df.withColumn("preprocessed", F.array_join(tokens, " "))


def stage_detail(
    df: DataFrame, text: str = "text", stopwords: Iterable[str] = (), mode: str = "substring"
) -> DataFrame:
    """Add what each cleaning stage produced: cleaning, tokenized, folding, tokens."""
    words = list(stopwords)
    cleaned = df.withColumn("cleaning", T.clean_text(F.col(text)))
    tokenized = cleaned.withColumn("tokenized", T.clean_words(F.col("cleaning")))
    return tokenized.withColumns(
        {
            "folding": F.lower(F.array_join("tokenized", " ")),
            "tokens": T.clean_tokens(F.col("cleaning"), words, mode, cleaned=True),
        }
    )


def exploded(df: DataFrame, keys: list, items: Column, name: str) -> DataFrame:
    """``(*keys, name)``, one row per array element.

    An inner ``explode`` makes Catalyst add ``size(items) > 0`` and push it down, so that
    everything ``items`` is computed from is computed twice. The outer form with a filter
    behind it gives the same rows once.
    """
    rows = df.select(*keys, F.explode_outer(items).alias(name))
    return rows.where(F.col(name).isNotNull())


def positioned_tokens(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """Long form ``(id, pos, term)``."""
    rows = df.select(id_col, F.posexplode_outer(tokens).alias("pos", "term"))
    return rows.where(F.col("term").isNotNull())


def regroup_tokens(tokens: DataFrame, id_col: str) -> DataFrame:
    """Back from ``(id, pos, term)`` to one ordered token array per document.

    A group is one document, so it is as large as the row it came from.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", "term")))
    return tokens.groupBy(id_col).agg(F.transform(ordered, lambda t: t["term"]).alias("tokens"))


def stopword_anti_join(tokens: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Drop exact stop words from long-form tokens; the list may have any size."""
    listed = stopwords.select(F.col("word").alias("term"), F.lit(True).alias("_stop")).distinct()
    marked = lookup_join(tokens, listed, "term", F.struct(*tokens.columns))
    return marked.where(F.col("_stop").isNull()).drop("_stop")


def build_stem_table(
    vocabulary: DataFrame, stem: Callable[[pd.Series], pd.Series]
) -> DataFrame:
    """Run a stemmer once per distinct term; returns ``(term, stem)``.

    ``stem`` maps a Series of words to a Series of stems; it is evaluated in Arrow batches.
    """

    @F.pandas_udf("string")
    def stem_batch(words: pd.Series) -> pd.Series:
        return stem(words)

    return vocabulary.select("term").distinct().select("term", stem_batch("term").alias("stem"))


def stem_arrays(tokens: Column, stem: Callable[[pd.Series], pd.Series]) -> Column:
    """The stems of a token array, empty ones dropped; nothing is shuffled.

    Evaluated in Arrow batches; each distinct word of a batch is stemmed once. NULL gives no stems.
    """

    @F.pandas_udf("array<string>")
    def stemmed(batch: pd.Series) -> pd.Series:
        lists = [[] if v is None else list(v) for v in batch]
        codes, words = pd.factorize(pd.Series([w for v in lists for w in v], dtype=object))
        stems = iter(stem(pd.Series(words, dtype=object)).to_numpy()[codes] if len(words) else [])
        return pd.Series([[s for s in (next(stems) for _ in v) if s] for v in lists], index=batch.index)

    return stemmed(tokens)


def apply_stems(tokens: DataFrame, stems: DataFrame, spread_by: Column) -> DataFrame:
    """Replace ``term`` by its stem where the ``(term, stem)`` table has one; drop empty ones."""
    joined = lookup_join(tokens, stems, "term", spread_by)
    return joined.withColumn("term", F.coalesce("stem", "term")).drop("stem").where("term <> ''")


def term_bag(tokens: Column) -> Column:
    """Term counts of one token array: ``array<struct<term, tf>>``, computed in the row.

    Sort the tokens, find where a new term starts, and take the distances between starts.
    """

    def runs(words: Column) -> Column:
        def starts_here(i: Column) -> Column:
            return (i == 0) | (F.get(words, i) != F.get(words, i - 1))

        every = F.sequence(F.lit(0), F.size(words) - 1)
        return let(F.filter(every, starts_here), lambda starts: lengths(words, starts))

    def lengths(words: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, k: F.struct(
                F.get(words, at).alias("term"),
                (F.coalesce(F.get(starts, k + 1), F.size(words)) - at).cast("long").alias("tf"),
            ),
        )

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs))


def term_counts(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Raw term count per document, long form ``(*keys, term, tf)``; no shuffle."""
    cells = df.select(*keys, F.inline_outer(term_bag(tokens)))
    return cells.where(F.col("term").isNotNull())


def global_words(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Every token of the corpus, repeats kept."""
    return exploded(df, keys, tokens, "word")


def term_frequency(df: DataFrame, tokens: Column) -> DataFrame:
    """Occurrences of each term over all token arrays."""
    words = exploded(df, [], tokens, "term")
    return words.groupBy("term").agg(F.count("*").alias("tf"))


def char_frequency(df: DataFrame, text: Column) -> DataFrame:
    """Occurrences of each character over all texts."""
    chars = exploded(df, [], T.characters(text), "ch").where(F.col("ch") != "")
    return chars.groupBy("ch").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, tokens: Column) -> DataFrame:
    """Distinct terms."""
    return exploded(df, [], tokens, "term").distinct()


def document_frequency(
    df: DataFrame,
    tokens: Column,
    terms: DataFrame | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``(term, df)``: number of documents containing a term.

    With ``terms`` the result has exactly these terms, 0 for those that never occur. A
    vocabulary of up to ``max_broadcast_rows`` terms filters the words before they are
    counted; a larger one is joined to the counts.
    """
    words = exploded(df, [], F.array_distinct(tokens), "term")
    if terms is None:
        return words.groupBy("term").agg(F.count("*").alias("df"))
    wanted = terms.select("term").distinct()
    if terms.count() <= max_broadcast_rows:
        words = words.join(F.broadcast(wanted), "term", "left_semi")
    counted = words.groupBy("term").agg(F.count("*").alias("df"))
    return wanted.join(counted, "term", "left").select(
        "term", F.coalesce("df", F.lit(0)).alias("df")
    )
