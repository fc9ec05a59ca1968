"""Operators that treat rows one by one, against brute force, the library or round trips."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
import xxhash

from opinion_spark.llm import chat, classifier, licenses, packing, pii, quality_rules, tokens
from opinion_spark.llm import sql as llm_sql
from opinion_spark.llm.span_model import SpanModel, classes_of, tags_of


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


ODD = ["don't WE'LL it's", "<|endoftext|>", "a<|startoftext|>b", "İstanbul Σας ΣΑΣ", "中文 12 ½", "\x1c a\x1db", "é é Å Å", "a b c", "!!...## _x_"]


def test_token_counts_equal_the_library(spark, library):
    rng = random.Random(2)
    letters = "aB 'sStTLLdI\t1<|#%éßıŁ́\u0085Σ中😀\x1c-–"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    rows = brute.AWKWARD + [(100 + i, t) for i, t in enumerate(texts)]
    got = Counter(tuple(r) for r in tokens.counted(brute.frame(spark, rows)).collect())
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = Counter((i, len((t or "").encode()), count(t), count(t) > 2048) for i, t in rows)
    assert got == want


def test_chunks_of_letters_need_no_pattern(library, monkeypatch):
    own = tokens.Shortcut(tokens.tokenizer_path())
    rng = random.Random(8)
    marks = ["", ".", ",", "'", "!", "\x00", "7", "é", "'s", "##", "-x"]
    chunks = ["".join(rng.choice("abcQRzéßİºЖ") for _ in range(rng.randint(1, 9))) + rng.choice(marks) for _ in range(600)]
    assert all(own.cut(c) == tokens.PRE_TOKEN.findall(c.lower()) for c in chunks)

    class NoPattern:
        @staticmethod
        def findall(text):
            raise AssertionError(text)

    monkeypatch.setattr(tokens, "PRE_TOKEN", NoPattern)
    for text in ("Ouquele tianly beonbleingnt. thwhlyha! Éçan, beonbleingnt", "tianly OUQUELE."):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), "<u4").tolist() == ids and own.count(text) == len(ids)
    # Chunks and pre-tokens share one memory.
    assert {"tianly", "ouquele", "Ouquele", "OUQUELE."} <= own.string_ids.keys()


def test_packing_places_every_piece_once(spark, library):
    rng = random.Random(3)
    rows = brute.AWKWARD + [(100 + i, " ".join(rng.choice(["alpha", "beta", "zzkq"]) for _ in range(rng.choice([1, 50, 900, 3000, 9000])))) for i in range(60)]
    out = packing.packed(brute.frame(spark, rows), with_ids=True).collect()
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [1]
    want = Counter()
    for key, text in rows:
        own = ids(text)
        for piece, start in enumerate(range(0, len(own), 4096)):
            data = np.array(own[start : start + 4096], "<u4").tobytes()
            want[(key, piece, start, len(data) // 4, zlib.crc32(data), data)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in out)
    assert len(sequences) <= -(-total // 4096) * 1.15 + 1
    assert packing.packed(brute.frame(spark, [])).collect() == []


def test_patterns_use_every_piece_and_few_sequences():
    rng = random.Random(9)
    for draw in (lambda: rng.randint(1, 4096), lambda: rng.randint(900, 2200), lambda: 1, lambda: 4096):
        counts = Counter(draw() for _ in range(700))
        used = Counter()
        found = packing.patterns(dict(counts))
        for times, chosen in found:
            assert sum(n * k for n, k in chosen.items()) <= 4096
            for n, k in chosen.items():
                used[n] += times * k
        assert used == counts
        assert sum(t for t, _ in found) <= 1.1 * -(-sum(n * k for n, k in counts.items()) // 4096) + 1


def test_two_pieces_replace_the_smallest():
    # 60 and 30 fill greedily; 30 gives way to 21 and 19, which fill the sequence.
    assert packing.patterns({60: 1, 30: 1, 21: 1, 19: 1}, 100)[0] == (1, {60: 1, 21: 1, 19: 1})


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = brute.AWKWARD + [(100 + i, "".join(rng.choice("ab \n#|") for _ in range(rng.randint(0, 120)))) for i in range(300)]
    out = quality_rules.judged(brute.frame(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in out) == Counter((i, *brute.base_counts(t)) for i, t in rows)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_prose_and_rejects_strange_distributions(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "in"] + [f"word{rng.randrange(10**6)}x"] * 5) for _ in range(n)) + "."
    rows = [(i, prose(rng.randint(120, 400)), "en") for i in range(80)]
    rows += [(900, " | ".join(f"cell{rng.randrange(10**6)}" for _ in range(400)), "en"), (901, prose(400).upper() + "!!", "en"), (902, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in quality_rules.kept_documents(docs).collect()}
    assert kept == set(range(80))
    assert quality_rules.kept_documents(docs.where("doc_id < 0")).collect() == []
    assert quality_rules.kept_documents(docs).columns == docs.columns


def test_every_character_is_in_one_class(spark):
    text = spark.createDataFrame([("aB1 .#é中 ",)], "t string")
    counts = quality_rules.class_counts(quality_rules.F.col("t"), quality_rules.words_of(quality_rules.F.col("t")))
    assert text.select(counts.alias("c")).first()["c"] == [1, 1, 1, 1, 2, 3]


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.-+1 2()9_%é\n0") for _ in range(rng.randint(0, 40)))
        assert pii.in_order(pii.base_spans(text)) == pii.in_order(brute.base_spans(text, pii.luhn))
    assert len(pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@")) == 0


def labelled(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        prose = lambda k: " ".join(rng.choice(["the", "of", "Thing", "and,", "word."]) for _ in range(k))
        item = rng.choice(["ann.b%d@mail%d.example.com", "+1 (0%d7) 555-77%d3", "10.2%d.31.%d", "room %d of %d"]) % (rng.randrange(10), rng.randrange(10))
        rows.append((1000 + i, f"{prose(rng.randint(5, 40))} {item} {prose(rng.randint(5, 40))}"))
    return rows


def test_the_gradient_is_right():
    rng = np.random.default_rng(0)
    model = SpanModel()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = rng.integers(1, 20, (3, 7))
    x[1, 5:] = 0
    y = np.tile(tags_of(7, [("email", 1, 4)]), (3, 1))
    _, grad = model.loss_and_gradient(x, y)
    for name, at in (("fx", (int(x[0, 2]), 5)), ("bh", (3, 9)), ("bc", (4,)), ("out", (6, 1)), ("move", (1, 2))):
        old, step = model.p[name][at], 1e-5
        model.p[name][at] = old + step
        up = model.loss_and_gradient(x, y)[0]
        model.p[name][at] = old - step
        down = model.loss_and_gradient(x, y)[0]
        model.p[name][at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-6


def test_spans_of_the_model_and_redaction(spark):
    rows = labelled(300, 1)
    docs = brute.frame(spark, rows + brute.AWKWARD)
    model = pii.trained(pii.training_windows(docs), steps=200)
    held = labelled(100, 2)
    parts = [(t[s : s + 64], [(k, a - s, b - s) for k, a, b in pii.base_spans(t) if a < s + 64 and b > s]) for _, t in held for s in range(0, len(t), 64)]
    x = pii._padded([classes_of(t) for t, _ in parts])
    y = pii._padded([tags_of(len(t), spans) for t, spans in parts])
    tags, _ = model.decode(x)
    assert (tags == y)[x > 0].mean() > 0.93
    out = {r["doc_id"]: r for r in pii.found(docs, model).collect()}
    assert len(out) == len({i for i, _ in rows + brute.AWKWARD})
    for i, text in rows:
        base = set(pii.written(pii.base_spans(text)).split(",")) - {""}
        assert base <= set(out[i]["spans"].split(","))
    clean = pii.redacted(docs, model)
    assert clean.columns == docs.columns
    assert not any(pii.base_spans(r["text"] or "") for r in clean.collect())
    assert {r["doc_id"] for r in clean.where("text is null").collect()} == {3}
    assert pii.found(brute.frame(spark, []), model).collect() == []


@pytest.fixture(scope="module")
def span_model(spark):
    return pii.trained(pii.training_windows(brute.frame(spark, labelled(600, 1))))


def test_the_model_adds_spans_of_other_formats(span_model):
    """Held-out items: the share of spans found, and of found spans that are right."""
    rng, np_rng = random.Random(5), np.random.default_rng(77)
    right = wanted = given = 0
    for _ in range(300):
        kind, form = rng.choice([*pii.VARIANTS, *((None, f) for f in pii.PLAIN)])
        before = " ".join(rng.choice(["the", "of", "Thing", "and,", "word."]) for _ in range(rng.randint(3, 200))) + " "
        item = pii._filled(form, np_rng)
        text = before + item + " the Thing of word."
        base = pii.base_spans(text)
        (added,) = pii.added_spans([text], [base], span_model)
        truth = (kind, len(before), len(before) + len(item))
        if kind and not base:
            wanted += 1
            right += truth in added
        given += len(added)
    assert right / wanted > 0.7
    assert right / given > 0.7


def test_spans_do_not_depend_on_where_windows_begin(span_model):
    """A span in any place of a long text, windows' edges included, and one longer than the overlap."""
    item = "(743) 555-3824"
    found = []
    for shift in range(pii.WINDOW - 40, pii.WINDOW + 40, 3):
        before = ("the Thing of word. and, " * 40)[:shift - 1] + " "
        text = before + item + " the Thing of word." * 40
        (added,) = pii.added_spans([text], [pii.base_spans(text)], span_model)
        found.append(("phone", shift, shift + len(item)) in added)
    assert np.mean(found) > 0.9

    class OneSpan:
        """Tags one span over the whole text, from its first character on."""

        def decode(self, x):
            return np.where(np.arange(x.shape[1]) + 0 * x == 0, 1, 2), np.ones(x.shape)

    text = "a" * 3000
    assert pii.added_spans([text, "", "b"], [[], [], []], OneSpan()) == [[("email", 0, 3000)], [], [("email", 0, 1)]]
    assert pii.added_spans([text], [[("card", 5, 9)]], OneSpan()) == [[]]


def test_only_doubtful_stretches_need_a_search(span_model):
    rng = random.Random(3)
    texts = [t for _, t in labelled(40, 8)] + ["".join(rng.choice("ab 12.@-(") for _ in range(rng.randint(1, 200))) for _ in range(40)]
    x = pii._padded([classes_of(t[:200]) for t in texts], 200)
    sides = [span_model._states(x, side) for side in "fb"]
    whole, _ = span_model._search(np.concatenate(sides, 2) @ span_model.p["out"] + span_model.p["bias"], x)
    tags, _ = span_model.decode(x)
    assert (tags == whole)[x > 0].mean() > 0.999  # rounding may break ties


def test_states_are_those_of_training_and_lie_gate_by_gate(span_model):
    texts = [t for _, t in labelled(30, 9)] + ["", "x", "é" * 70, "+1 234 567 8901 " * 4]
    x = pii._padded([classes_of(t[:90]) for t in texts], 90)
    for side in "fb":
        states, _ = span_model._lstm(x, side)
        own = span_model._states(x, side)
        assert np.abs(own - states)[x.T > 0].max() < 1e-5
        assert own[0].T.flags["C_CONTIGUOUS"]
    steep = SpanModel()
    steep.p = {k: v * 400 for k, v in steep.p.items()}
    assert np.isfinite(steep._states(x, "f")).all()


def test_only_stretches_that_hold_a_span_are_searched_in_full(span_model):
    rng = random.Random(4)
    plain = [" ".join(rng.choice(["the", "of", "Thing", "and,", "word.", "1234", "é"]) for _ in range(60)) for _ in range(200)]
    texts = plain + ["".join(rng.choice("ab 12.@-(") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    x = pii._padded([classes_of(t[:200]) for t in texts], 200)
    searched, search = [], span_model._search
    span_model._search = lambda e, some: searched.append(some) or search(e, some)
    try:
        tags, _ = span_model.decode(x)
    finally:
        del span_model._search
    tagged = (np.diff(np.pad(tags > 0, ((0, 0), (1, 0))).astype(np.int8)) == 1).sum()
    assert 0 < sum(map(len, searched)) <= tagged  # only stretches that hold a span
    sides = [span_model._states(x, side) for side in "fb"]
    whole, _ = span_model._search(np.concatenate(sides, 2) @ span_model.p["out"] + span_model.p["bias"], x)
    assert (tags == whole)[x > 0].mean() > 0.999  # rounding may break ties


def test_a_window_sample_reads_the_texts_once(spark):
    rows = labelled(400, 6)
    reads = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    docs = brute.frame(spark, rows)
    seen = docs.mapInArrow(passed, docs.schema)
    found = pii.training_windows(seen, sample=(20, 30))
    assert reads.value == len(rows)
    hashed = {}
    for _, text in rows:
        spans = pii.base_spans(text)
        for s in range(0, len(text), pii.LEARNT):
            has = any(a < s + pii.LEARNT and b > s for _, a, b in spans)
            window = text[s : s + pii.LEARNT]
            hashed[xxhash.xxh3_64_intdigest(window.encode()) >> 1] = (has, window)
    least = [sorted(o for o, (has, _) in hashed.items() if has == kind)[:n] for kind, n in ((True, 20), (False, 30))]
    assert [w for w, _ in found] == [hashed[o][1] for o in sorted(sum(least, []))]


def test_redaction_of_overlapping_spans():
    assert pii.redact("ab 12 cd", [("ip", 3, 5), ("card", 4, 6)]) == "ab [IP]cd"


def test_the_classifier_separates_on_held_out_rows(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["fine", "good", "clear"] if i % 3 else ["junk##", "spam$$"]) for _ in range(rng.randint(5, 60)))) for i in range(600)]
    docs = brute.frame(spark, rows + [(None, "fine"), (700, None), (701, "")])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    weights = classifier.trained(classifier.labelled_sample(docs, labels), label="label")
    out = classifier.scored(docs, weights).collect()
    assert len(out) == 603
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) == len(held)


def test_perspectives_render_whole_dialogues(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "<|end|> yo"), (1, 2, None, None), (2, 0, "system", "be"), (2, 1, "ann", "é😀"), (2, 1, "ann", "é😀"), (None, None, "bob", "x"), (3, 0, "system", "only")]
    rows += [(4, i, "ann" if i % 2 else "cid", f"t{i}") for i in range(150)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", chat.F.lit(1))
    out = {}
    for r in sorted(chat.rotated(talk, block=4).collect(), key=lambda r: r["block"]):
        whole = out.setdefault((r["conv_id"], r["perspective"]), ["", []])
        assert r["start"] == len(whole[0])
        whole[0] += r["dialogue"]
        whole[1] += [tuple(map(int, m.split("-"))) for m in r["masks"].split(",") if m]
    assert set(out) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "bob"), (4, "ann"), (4, "cid")}
    text, masks = out[(1, "bob")]
    assert text == "<|user name=ann|>\nhi<|end|>\n<|assistant|>\n< |end|> yo<|end|>\n<|user name=unknown|>\n<|end|>\n"
    assert [text[a:b] for a, b in masks] == ["< |end|> yo<|end|>\n"]
    text, masks = out[(2, "ann")]
    assert text.startswith("<|system|>\nbe<|end|>\n") and [text[a:b] for a, b in masks] == ["é😀<|end|>\n"] * 2
    text, masks = out[(4, "cid")]
    assert [text[a:b] for a, b in masks] == [f"t{i}<|end|>\n" for i in range(0, 150, 2)]
    assert chat.rotated(talk.where("conv_id < 0")).collect() == []


def test_licenses_are_found_by_containment(spark):
    import re

    def shingles(text):
        w = re.sub(r"[^\w]+|_", " ", (text or "").lower()).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rng = random.Random(12)
    rows = list(brute.AWKWARD)
    names = list(licenses.TEMPLATES)
    for i in range(80):
        w = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(0, 600))]
        part = licenses.TEMPLATES[rng.choice(names)].split()
        part = part[: max(5, int(len(part) * rng.choice([1, 1, 0.9, 0.5])))]
        at = rng.randint(0, len(w))
        w[at:at] = part
        rows.append((100 + i, " ".join(w)))
    want = Counter()
    for doc, text in rows:
        for name, template in licenses.TEMPLATES.items():
            t = shingles(template)
            if 100 * len(t & shingles(text)) >= 75 * len(t):
                want[(doc, name, len(t), len(t & shingles(text)))] += 1
    assert Counter(tuple(r) for r in licenses.scanned(brute.frame(spark, rows)).collect()) == want
    assert licenses.scanned(brute.frame(spark, [])).collect() == []


def test_sql_is_of_registered_queries():
    from opinion_spark.llm.queries import QUERIES

    assert set(llm_sql.SQL) <= set(QUERIES)
