from __future__ import annotations

from pyspark.sql import functions as F

from opinion_spark.functions import text as T
from opinion_spark.operators import lexicon as L
from opinion_spark.sources import datasets, files
from opinion_spark.sources import models as saved

CRAWL = (
    ",status_id,created_at,screen_name,text,extra\n"
    '0,x1328208693461196803,2020-11-16,user_a,"Halo, ""dunia""\nbaris dua",9\n'
    "1,x2,2020-11-17,user_b,,8\n"
)


def test_csv_by_header_name(spark, tmp_path):
    path = tmp_path / "crawl.csv"
    path.write_text(CRAWL)
    rows = files.read_csv(spark, str(path), files.CRAWL_SCHEMA)
    assert rows.columns == ["status_id", "created_at", "screen_name", "text"]
    found = rows.orderBy("status_id").collect()
    assert found[0]["status_id"] == "x1328208693461196803"
    assert found[0]["text"] == 'Halo, "dunia"\nbaris dua' and found[1]["text"] is None
    some = files.read_csv(spark, str(path), files.CRAWL_SCHEMA, ["text"])
    assert some.columns == ["text"]
    landed = files.land(rows, str(tmp_path / "landed"))
    assert landed.count() == 2 and landed.schema == rows.schema


def test_typed_columns(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("source,verified,text,retweet_count\nweb,True,a,12.0\nweb,False,b,\nweb,,c,7\n")
    schema = "text string, retweet_count bigint, verified boolean, source string"
    found = files.read_csv(spark, str(path), schema).orderBy("text").collect()
    assert [r["retweet_count"] for r in found] == [12, None, 7]
    assert [r["verified"] for r in found] == [True, False, None]


def test_tagged_crawls(spark, tmp_path):
    paths = {}
    for name in ("ruu.minol", "ruu.miras2"):
        paths[name] = str(tmp_path / f"{name}.csv")
        (tmp_path / f"{name}.csv").write_text(CRAWL)
    rows = files.read_tagged_csv(spark, paths, files.CRAWL_SCHEMA).collect()
    assert {(r["source_name"], r["keyword"]) for r in rows} == {("ruu.minol", 0), ("ruu.miras2", 1)}


def test_lexicon_and_word_lists(spark, tmp_path):
    (tmp_path / "lex.csv").write_text("word,weight\nbaik,3\nburuk,-4\nbaik,5\n")
    found = {r["word"]: r["weight"] for r in files.read_lexicon(spark, str(tmp_path / "lex.csv")).collect()}
    assert found == {"baik": "5", "buruk": "-4"}
    (tmp_path / "stop.txt").write_text("yang\ndi\n")
    assert [r["word"] for r in files.read_words(spark, str(tmp_path / "stop.txt")).collect()] == ["yang", "di"]


def test_stage_results_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["baik", "buruk"]), (2, [])], "id int, tokens array<string>")
    words = spark.createDataFrame([("baik", "3")], "word string, weight string")
    frame = L.classify_frame(docs, "id", F.col("tokens"), words).drop("tokens")
    files.write_csv(frame, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), "id int, classify_data string, classified int")
    found = {r["id"]: (r["classify_data"], r["classified"]) for r in back.collect()}
    assert found == {1: ('{"baik":3,"buruk":0}', 1), 2: ("{}", 0)}


def test_token_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"]), (-1, ["c"]), (1, ["a"])], "c int, tokens array<string>")
    files.write_tokens(rows, F.col("tokens"), str(tmp_path / "all"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "all")).collect()) == ["a", "a", "b", "c"]
    files.write_group_tokens(rows, "c", F.col("tokens"), str(tmp_path / "by"))
    found = spark.read.text(str(tmp_path / "by")).collect()
    assert sorted((r["c"], r["value"]) for r in found) == [(-1, "c"), (1, "a"), (1, "a"), (1, "b")]
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "by" / "c=-1")).collect()) == ["c"]


def test_results_of_several_runs(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.5), (2, 0.6)], "split int, accuracy double")
    for run in ("nb", "svm"):
        files.append_results(scores, str(tmp_path / "results"), run)
    files.append_results(scores, str(tmp_path / "results"), "nb")
    files.append_results(scores.where("split > 9"), str(tmp_path / "results"), "svm")
    table = spark.read.parquet(str(tmp_path / "results"))
    assert table.count() == 4 and {r["run_id"] for r in table.collect()} == {"nb", "svm"}


def test_parameter_models(spark, tmp_path):
    params = spark.createDataFrame([(0, 0.5, [1.0], [2.0])], "label int, prior double, mean array<double>, var array<double>")
    saved.save_parameters(params, str(tmp_path / "nb"))
    assert saved.load_parameters(spark, str(tmp_path / "nb")).collect() == params.collect()


def test_named_data_sets(spark, sf_dir):
    catalogue = {
        "classified-clean": datasets.DataSet(f"{sf_dir}/documents.parquet", columns=("doc_id", "text")),
        "file": None,
    }
    assert datasets.open_dataset(spark, catalogue, "classified-clean").columns == ["doc_id", "text"]
    assert datasets.open_dataset(spark, catalogue, "file") is None
    datasets.register_views(spark, catalogue)
    assert spark.sql("SELECT count(*) AS n FROM classified_clean").first()["n"] == 200


def test_files_with_other_column_orders_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("word,weight\nbaik,3\n")
    (tmp_path / "b.csv").write_text("weight,word\n-4,buruk\n")
    found = files.read_csv(spark, str(tmp_path / "*.csv"), files.LEXICON_SCHEMA).collect()
    assert sorted((r["word"], r["weight"]) for r in found) == [("baik", "3"), ("buruk", "-4")]
