"""Cleaning and tokenising on literal inputs and against plain Python on random text."""

from __future__ import annotations

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from opinion_spark.functions import text as T


def column(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = rows.select("i", expression(F.col("text")).alias("out")).collect()
    return [r["out"] for r in sorted(found, key=lambda r: r["i"])]


def one(spark, text, expression):
    return column(spark, [text], expression)[0]


def scanned(text):
    """The clean form of a text, found by walking over its characters."""
    plain, at = [], 0
    while at < len(text):
        if text[at] == "\\":
            if text[at + 1 : at + 2] in ("t", "n", "u") and text[at + 1 : at + 2]:
                plain.append(" ")
                at += 1
        else:
            plain.append(text[at] if text[at].isascii() else "?")
        at += 1
    letter = lambda c: c.isalnum() or c == "_"
    out, at = [], 0
    while at < len(plain):
        end = at + 1
        if plain[at] in "@#":
            while end < len(plain) and plain[end].isalnum():
                end += 1
            out.append(plain[at] if end == at + 1 else " ")
        elif letter(plain[at]):
            while end < len(plain) and letter(plain[end]):
                end += 1
            rest = end + 3
            if "".join(plain[end:rest]) == "://" and rest < len(plain) and not plain[rest].isspace():
                while rest < len(plain) and not plain[rest].isspace():
                    rest += 1
                out.append(" ")
                end = rest
            else:
                out += plain[at:end]
        else:
            out.append(plain[at])
        at = end
    words = " ".join("".join(out).split())
    for scheme in ("http", "https"):
        words = " ".join(words.split(scheme + "://"))
    kept = [c for c in words if letter(c) and c != "_" and not c.isdigit() or c.isspace() or not c.isprintable()]
    return " ".join("".join(kept).split())


def py_runs(text):
    return re.split(r"(\W+)", text)


def noise(count, seed=7):
    rng = random.Random(seed)
    pieces = [
        "kata", "Warga", "@user1", "#tag_x", "http://t.co/a", "https://", "ab://c", "_x://y",
        "\\t", "\\n", "\\u", "\\", "\t", "\n", "\r", "\x1c", "\x01\x02", "é", "😀", "漢字", "\xa0",
        "\u2003", "42", "٣", "don't", "[a]", "^b`", "{|}~", "?!", ". ", "! ", "  ", " ", "@é", "#",
        "://", "a@b", "\x7f", "x",
    ]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(count)]


def test_literal_cases(spark):
    assert one(spark, "halo @user1 #tag_x http://t.co/a b", T.strip_mentions_urls) == "halo _x b"
    assert one(spark, "don't [a]^b`{|}~", T.remove_punctuation) == "dont ab"
    assert one(spark, "aé😀b", T.ascii_replace) == "a??b"
    assert one(spark, "a, b", T.tokenize_words) == ["a", ",", "b"]
    assert one(spark, r"a\tb\nc\ud\e", T.clean_escapes) == "a b c de"
    assert one(spark, "a1b22c", T.remove_numbers) == "abc"


def test_a_whole_text(spark):
    text = "Warga Kota 12 senang, kata @ketua_rt. Pasar dibuka lagi! https://contoh.example/a1 http://x.example"
    assert one(spark, text, T.clean_text) == "Warga Kota senang kata rt Pasar dibuka lagi"
    assert one(spark, text, T.sentence_split)[1] == "pasar dibuka lagi"


def test_clean_text_on_random_text(spark):
    texts = noise(3000)
    assert column(spark, texts, T.clean_text) == [scanned(t) for t in texts]


def test_single_steps_on_random_text(spark):
    texts = noise(1500, 11)
    strip = lambda t: " ".join(re.sub(r"[@#][A-Za-z0-9]+|\w+://\S+", " ", t).split())
    assert column(spark, texts, T.strip_mentions_urls) == [strip(t) for t in texts]
    assert column(spark, texts, T.trim_whitespace) == [t.strip() for t in texts]
    assert column(spark, texts, T.collapse_whitespace) == [re.sub(r"\s+", " ", t) for t in texts]
    assert column(spark, texts, T.remove_numbers) == [re.sub(r"\d+", "", t) for t in texts]


def test_tokenizers_on_random_text(spark):
    texts = noise(1500, 13)

    def words(t):
        parts = py_runs(re.sub("[\r\n]", " ", t))
        return [p.strip().lower() for p in parts]

    def sentences(t):
        return [p.strip().lower() for p in re.split(r"[.?!][ \n]", re.sub("[\r\n]", " ", t))]

    assert column(spark, texts, T.tokenize_words) == [words(t) for t in texts]
    assert column(spark, texts, T.sentence_split) == [sentences(t) for t in texts]
    kept = [[p for p in py_runs(t) if " " not in p] for t in texts]
    assert column(spark, texts, T.split_words) == kept


@pytest.mark.parametrize("stopwords", [[], ["yang", "wargaku", "dont"]])
def test_clean_tokens_on_random_text(spark, stopwords):
    texts = noise(1500, 17)
    blob = "\n".join(stopwords)

    def tokens(t):
        parts = [p for p in py_runs(scanned(t)) if " " not in p and len(p) >= 2]
        return [p.strip().lower() for p in parts if not stopwords or p not in blob]

    assert column(spark, texts, lambda c: T.clean_tokens(c, stopwords)) == [tokens(t) for t in texts]


def test_stopword_modes(spark):
    words = ["untuk", "dari"]
    tokens = F.array(*[F.lit(t) for t in ("tu", "untuk", "Untuk", "ari", "rumah")])
    row = spark.range(1).select(
        T.drop_stopwords(tokens, words).alias("sub"),
        T.drop_stopwords(tokens, words, "exact").alias("exact"),
    )
    found = row.first()
    assert found["sub"] == ["Untuk", "rumah"]
    assert found["exact"] == ["tu", "Untuk", "ari", "rumah"]
    with pytest.raises(ValueError):
        T.drop_stopwords(tokens, words, "prefix")


def test_a_stop_word_may_be_a_phrase(spark):
    tokens = F.array(*[F.lit(t) for t in ("of the", "of", "f t", "the of")])
    found = spark.range(1).select(T.drop_stopwords(tokens, ["of the", "dari"]).alias("t")).first()
    assert found["t"] == ["the of"]


def test_missing_and_empty_text(spark):
    texts = [None, ""]
    assert column(spark, texts, T.word_count) == [0, 1]
    assert column(spark, ["a  b ", "a"], T.word_count) == [4, 1]
    assert column(spark, texts, T.clean_text) == [None, ""]
    assert column(spark, texts, lambda c: F.array_join(T.clean_tokens(c), " ")) == [None, ""]
    assert one(spark, "Satu. Dua!", T.clean_sentences) == ["satu dua"]


def test_unbroken_run_is_linear(spark):
    run = "x" * 400_000 + "@"
    assert one(spark, run, lambda c: F.length(T.clean_text(c))) == 400_000


def test_space_characters_are_pythons():
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    assert sorted(T.SPACE_CHARACTERS) == spaces
    assert set(T.PUNCTUATION) == set(string.punctuation)
