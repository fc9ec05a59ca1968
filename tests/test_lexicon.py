from __future__ import annotations

from pyspark.sql import functions as F

from opinion_spark.functions import encode as E
from opinion_spark.operators import lexicon as L
from opinion_spark.operators import predictors as P
from opinion_spark.operators import weights as W


def lexicon(spark, rows):
    return spark.createDataFrame(rows, "word string, weight string")


def test_weights_are_truncated_and_bad_ones_are_zero(spark):
    given = ["3", "-2", "2.9", "-2.9", "nan", "inf", "text", None]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(given)], "i int, weight string")
    found = rows.orderBy("i").select(L.int_weight(F.col("weight")).alias("w")).collect()
    assert [r["w"] for r in found] == [3, -2, 2, -2, 0, 0, 0, 0]


def test_last_weight_of_a_word_counts(spark):
    raw = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 5, 2)], "word string, weight int, o int")
    found = {r["word"]: r["weight"] for r in L.last_weight_per_word(raw, F.col("o")).collect()}
    assert found == {"a": 5, "b": 2}


def test_classify_counts_every_occurrence_and_keeps_empty_documents(spark):
    docs = spark.createDataFrame(
        [(1, ["baik", "baik", "buruk"]), (2, ["buruk"]), (3, []), (4, None), (5, ["lain"])],
        "id int, tokens array<string>",
    )
    words = lexicon(spark, [("baik", "3"), ("buruk", "-5")])
    found = {
        r["id"]: (r["score"], r["classified"])
        for r in L.classify(docs, "id", F.col("tokens"), words).collect()
    }
    assert found == {1: (1, 1), 2: (-5, -1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
    frame = L.classify_frame(docs, "id", F.col("tokens"), words)
    maps = {r["id"]: r["classify_data"] for r in frame.collect()}
    assert maps[1] == {"baik": 3, "buruk": -5}
    assert maps[5] == {"lain": 0}
    assert maps[3] == {} and maps[4] == {}


def test_dictionary_in_the_row_equals_the_join(spark):
    rows = [(1, ["b", "a", "b", "zz"]), (1, ["a"]), (2, []), (3, None), (4, ["é", "b"]), (None, ["a", "a"])]
    docs = spark.createDataFrame(rows, "id int, tokens array<string>")
    words = lexicon(spark, [("a", "3"), ("b", "-5"), ("é", "1"), (None, "9")])
    tokens = F.col("tokens")
    for run in (L.sentence_scores, L.word_scores, L.word_score_map, L.classify_frame):
        near, far = run(docs, "id", tokens, words), run(docs, "id", tokens, words, max_bytes=0)
        assert near.columns == far.columns
        assert [f.dataType.simpleString() for f in near.schema] == [f.dataType.simpleString() for f in far.schema]
        assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))
    nothing = lexicon(spark, [])
    assert {r["score"] for r in L.sentence_scores(docs, "id", tokens, nothing).collect()} == {0}
    assert L.word_score_map(docs.where("id > 99"), "id", tokens, words).collect() == []


def test_feature_rows_in_the_row_equal_the_join(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "zz"]), (2, []), (3, None), (4, ["c"])], "id int, tokens array<string>")
    terms = spark.createDataFrame([("a", 1, 2), ("b", 2, 0), ("c", 4, 1)], "term string, df long, index long")
    near, far = (W.sparse_features(docs, "id", F.col("tokens"), terms, 4, max_bytes=size) for size in (1000, 0))
    assert near.orderBy("id").collect() == far.orderBy("id").collect()
    assert near.orderBy("id").first()["indices"] == [0, 2]


PREDICTORS = (
    "text string, hashtags string, followers_count bigint, friends_count bigint, "
    "favourites_count bigint, favorite_count bigint, retweet_count bigint, verified boolean, "
    "source string"
)


def test_predictor_table(spark):
    rows = [
        ("satu dua", "tag", 1, 2, 3, 4, 5, True, "Twitter for iPhone"),
        (None, None, None, 2, None, 4, None, False, "Twitter for Android"),
        ("a  b ", None, 1, 2, 3, 4, 5, None, "Twitter Web App"),
        ("x", "t", 1, 2, 3, 4, 5, True, "elsewhere"),
        ("x", "t", 1, 2, 3, 4, 5, True, None),
    ]
    source = spark.createDataFrame(rows, PREDICTORS)
    found = P.predictor_table([(source, 0), (source, 2)]).collect()
    assert len(found) == 10
    assert {r["keyword"] for r in found} == {0, 2}
    first = [r for r in found if r["keyword"] == 2]
    assert [r["source"] for r in first] == [0, 1, 2, 3, 3]
    assert [r["hashtags"] for r in first] == [1, 0, 0, 1, 1]
    assert [r["verified"] for r in first] == [1, 0, 0, 1, 1]
    assert [r["word_count"] for r in first] == [2, 0, 4, 1, 1]
    assert first[1]["text"] == "0" and first[1]["followers_count"] == 0
    assert {r["classified"] for r in first} == {""}


def test_class_names_become_codes_everywhere(spark):
    rows = [("positive", "netral"), ("negative", "other"), ("netral", "positive"), ("1", "x"), ("?", None)]
    frame = spark.createDataFrame(rows, "classified string, note string")
    found = P.encode_classes(frame, "classified").collect()
    assert [r["classified"] for r in found] == [1, -1, 0, 1, None]
    assert [r["note"] for r in found] == ["0", "other", "1", "x", None]


def test_flags(spark):
    rows = spark.createDataFrame([(0, ""), (1, "a"), (2, None)], "i int, hashtag string").orderBy("i")
    found = P.hashtag_flag(rows).collect()
    assert [r["hashtag_vp"] for r in found] == [0, 1, 1]
    present = rows.select(E.presence_flag(F.col("hashtag")).alias("p")).collect()
    assert [r["p"] for r in present] == [1, 1, 0]
    filled = P.fill_zero(rows.withColumn("n", F.lit(None).cast("double"))).collect()
    assert filled[2]["hashtag"] == "0" and filled[2]["n"] == 0.0


def test_rows_of_equal_ids_have_results_of_their_own(spark):
    lexicon = spark.createDataFrame([("good", 2), ("bad", -3)], "word string, weight int")
    docs = spark.createDataFrame([(1, ["good"]), (1, ["bad"]), (1, ["bad"]), (None, ["good"]), (2, [])], "id int, tokens array<string>")
    scores = sorted(((r["id"] or 0), r["score"], r["classified"]) for r in L.classify(docs, "id", F.col("tokens"), lexicon).collect())
    assert scores == [(0, 2, 1), (1, -3, -1), (1, -3, -1), (1, 2, 1), (2, 0, 0)]
    maps = [(r["id"], r["classify_data"]) for r in L.word_score_map(docs, "id", F.col("tokens"), lexicon).collect()]
    assert sorted(((i or 0), *m.items()) for i, m in maps) == [(0, ("good", 2)), (1, ("bad", -3)), (1, ("bad", -3)), (1, ("good", 2))]
    framed = L.classify_frame(docs, "id", F.col("tokens"), lexicon).collect()
    assert len(framed) == 5 and sorted((r["id"] or 0, r["classified"]) for r in framed) == [(0, 1), (1, -1), (1, -1), (1, 1), (2, 0)]
