from __future__ import annotations

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinion_spark.operators import clouds as C
from opinion_spark.operators import lookup
from opinion_spark.operators import vocabulary as V
from opinion_spark.operators import weights as W


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["a"] * 30 + ["b"] * 6 + ["c", "d", "e", "f", "g"]
    return [(i, [rng.choice(words) for _ in range(rng.randint(0, 30))]) for i in range(400)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "id int, tokens array<string>").repartition(5)


def test_recorded_frequencies(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "c", "c"], "aabbbcdefggg")], "t array<string>, s string")
    terms = {r["term"]: r["tf"] for r in V.term_frequency(rows, F.col("t")).collect()}
    assert terms == {"a": 1, "b": 1, "c": 3}
    chars = {r["ch"]: r["n"] for r in V.char_frequency(rows, F.col("s")).collect()}
    assert chars == Counter("aabbbcdefggg")


def test_term_counts_are_exact(docs, corpus):
    found = {(r["id"], r["term"]): r["tf"] for r in V.term_counts(docs, ["id"], F.col("tokens")).collect()}
    want = {(i, t): n for i, tokens in corpus for t, n in Counter(tokens).items()}
    assert found == want


def test_document_frequency_with_given_terms(docs, corpus, spark):
    terms = spark.createDataFrame([("a",), ("c",), ("never",)], "term string")
    want = {t: sum(t in tokens for _, tokens in corpus) for t in ("a", "c", "never")}
    for bound in (10, 0):
        counted = V.document_frequency(docs, F.col("tokens"), terms, max_broadcast_rows=bound)
        assert {r["term"]: r["df"] for r in counted.collect()} == want


def test_idf_values(spark):
    rows = spark.createDataFrame([("x", 5), ("none", 0), ("more", 6104)], "term string, df bigint")
    found = {r["term"]: r["idf"] for r in W.idf_table(rows, 6103).collect()}
    assert found["x"] == pytest.approx(7.107097820110394, abs=1e-12)
    assert found["none"] == 0.0
    assert found["more"] < 0


@pytest.mark.parametrize("bound", [1000, 0])
def test_tfidf_with_broadcast_and_with_salted_join(docs, corpus, bound):
    weights = W.tfidf(docs, "id", F.col("tokens"), max_broadcast_rows=bound)
    found = {(r["id"], r["term"]): (r["tf"], r["weight"]) for r in weights.collect()}
    n = len(corpus)
    df = Counter(t for _, tokens in corpus for t in set(tokens))
    want = {
        (i, t): (tf, tf * math.log(n / df[t]))
        for i, tokens in corpus
        for t, tf in Counter(tokens).items()
    }
    assert found.keys() == want.keys()
    for key, (tf, weight) in want.items():
        assert found[key][0] == tf
        assert found[key][1] == pytest.approx(weight, abs=1e-9)


def test_salted_join_spreads_a_frequent_key(spark, monkeypatch):
    monkeypatch.setattr(lookup, "SHARES", 16)
    facts = spark.range(9000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id")))
        .alias("term"),
    )
    table = facts.where("term is not null").select("term").distinct()
    table = table.withColumn("w", F.length("term"))
    joined = lookup.lookup_join(facts, table, "term", F.col("id"), max_broadcast_rows=0)
    found = joined.select(F.count("*"), F.sum("w"), F.count("w")).first()
    plain = facts.join(table, "term", "left").select(F.count("*"), F.sum("w"), F.count("w")).first()
    assert tuple(found) == tuple(plain) and found[0] == 9000
    inner = lookup.lookup_join(facts, table, "term", F.col("id"), how="inner", max_broadcast_rows=0)
    assert inner.count() == 6000


def test_stop_words_by_join(spark):
    docs = spark.createDataFrame([(1, ["untuk", "rumah", "untukmu"])], "id int, tokens array<string>")
    tokens = V.positioned_tokens(docs, "id", F.col("tokens"))
    stop = spark.createDataFrame([("untuk",), ("untuk",)], "word string")
    kept = V.stopword_anti_join(tokens, stop).orderBy("pos").collect()
    assert [r["term"] for r in kept] == ["rumah", "untukmu"]


def test_stems_keep_the_order_of_words(spark):
    docs = spark.createDataFrame(
        [(1, ["makanan", "rumah", "makanan"]), (2, ["an"])], "id int, tokens array<string>"
    )

    def stem(words: pd.Series) -> pd.Series:
        return words.str.replace("an$", "", regex=True)

    stems = V.build_stem_table(V.vocabulary(docs, F.col("tokens")), stem)
    tokens = V.positioned_tokens(docs, "id", F.col("tokens"))
    grouped = V.regroup_tokens(V.apply_stems(tokens, stems, F.col("pos")), "id")
    assert {r["id"]: r["tokens"] for r in grouped.collect()} == {1: ["makan", "rumah", "makan"]}


def test_vectors_and_columns_agree_with_the_long_form(docs, corpus):
    frequencies = V.document_frequency(docs, F.col("tokens"))
    vectors, terms = W.tfidf_vectors(docs, "tokens", frequencies, 3, len(corpus))
    wide = {r["id"]: r for r in W.doc_term_columns(vectors, ["id"], "features", terms).collect()}
    long = {(r["id"], r["term"]): r["weight"] for r in W.tfidf(docs, "id", F.col("tokens")).collect()}
    assert terms[0] == "a" and len(terms) == 3 and len(wide) == len(corpus)
    for i, _ in corpus:
        for term in terms:
            assert wide[i][f"t_{term}"] == pytest.approx(long.get((i, term), 0.0), abs=1e-9)


def test_words_per_class(spark):
    rows = spark.createDataFrame(
        [(1, "baik sekali"), (1, "baik"), (-1, None), (-1, "buruk")], "c int, preprocessed string"
    )
    counts = C.group_word_counts(rows, "c", V.split_stored(F.col("preprocessed")))
    found = {(r["c"], r["word"]): r["n"] for r in counts.collect()}
    assert found == {(1, "baik"): 2, (1, "sekali"): 1, (-1, "buruk"): 1}


def test_documents_without_tokens_are_stemmed_too(spark):
    docs = spark.createDataFrame([(1, ["makanan", "nan"]), (2, []), (3, None)], "id int, tokens array<string>")
    stems = V.stem_arrays(F.col("tokens"), lambda words: words.str.replace("nan", ""))
    found = docs.select("id", F.array_join(stems, " ").alias("s")).collect()
    assert sorted((r["id"], r["s"]) for r in found) == [(1, "maka"), (2, ""), (3, "")]
