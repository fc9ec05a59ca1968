"""Near copies, repeated passages and benchmark items against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from opinion_spark.llm import components, decontaminate, jaccard, substrings
from opinion_spark.llm import words as W


def near_copies(seed: int, n: int = 260) -> list[tuple]:
    """Groups of edited copies of three passages, large enough for long columns, among unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(k)] for k in (60, 24, 12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    return rows + [(1000 + n + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(60)]


def components_of(spark, rows, extra=True):
    out = jaccard.link_components(brute.frame(spark, rows, extra)).collect()
    return Counter(tuple(r) for r in out), Counter(brute.linked(rows))


def test_awkward_documents_link(spark):
    got, want = components_of(spark, brute.AWKWARD)
    assert got == want
    assert jaccard.link_components(brute.frame(spark, [])).collect() == []


@pytest.mark.parametrize("short", [2, 32])
def test_near_copies_link_as_in_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    got, want = components_of(spark, near_copies(5), extra=False)
    assert got == want


def test_long_sets_are_told_apart_before_they_are_moved():
    values = np.unique(np.random.default_rng(3).integers(1, 1 << 63, 9000).astype(np.uint64))
    # Halves that overlap, a set of other length that is linked, equal sets, sets just below and at the limit.
    cases = [(values[:4000], values[1000:5000]), (values[:4000], values[:3200]), (values[:50], values[:50]), (values[:100], values[:74]), (values[:100], values[:75])]
    columns = [list(range(5)), list(range(5)), *[[len(c[k]) for c in cases] for k in (0, 1)], *[[jaccard._signature(c[k]) for c in cases] for k in (0, 1)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n_a", "n_b", "signature_a", "signature_b"])
    (out,) = jaccard._possible(iter([batch]))
    left = out.column(0).to_pylist()
    assert 0 not in left and 3 not in left and {1, 2, 4} <= set(left)


def test_a_task_gives_a_set_once():
    class Shared:
        value = np.full(1, 255, np.uint8)

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["same words here"] * 2 + ["other words"])], ["key", "text"])
    assert sum(b.num_rows for b in jaccard._sets(Shared)(iter([batch, batch]))) == 2


def test_one_document_per_component_stays(spark):
    rows = brute.AWKWARD + near_copies(6, 40)
    docs = brute.frame(spark, rows)
    kept = jaccard.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    groups = {c for i, n, c in brute.linked(rows) if n}
    without_shingles = [r for r in rows if not brute.shingles(r[1])]
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert sum(got.values()) == len(groups) + len(without_shingles)
    assert got[(8, "same words " * 40)] == 1 and got[(2, rows[1][1])] == 0
    assert groups - {None} == {i for (i, t) in got if brute.shingles(t)} - {None}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a long, b long")
    got = {(r["node"], r["root"]) for r in components.components(edges).collect()}
    assert got == {(i, 0) for i in range(301)} | {(900, 900), (901, 900)}
    assert components.components(edges.where("a < 0")).collect() == []


def repeated(spark, rows, width):
    out = substrings.removed_repeats(brute.frame(spark, rows), width=width)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect())
    want = Counter((i, n, g, hashlib.sha256(t).hexdigest()) for i, n, g, t in brute.without_repeats(rows, width))
    return got, want


def test_repeats_are_removed_as_in_brute_force(spark):
    rng = random.Random(4)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randint(20, 70))] for _ in range(6)]
    rows = list(brute.AWKWARD)
    for i in range(120):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 25))]
            p = rng.choice(passages)
            w += p[rng.randint(0, 5) : len(p) - rng.randint(0, 5)]
        rows.append((100 + i, " ".join(w)))
    for width in (35, 21):
        got, want = repeated(spark, rows, width)
        assert got == want


def test_runs_of_occurrences_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(substrings, "RUN_ROWS", 40)
    rows = [(i, " ".join(f"w{j % 17}" for j in range(60 + i % 5))) for i in range(30)]
    got, want = repeated(spark, rows, 35)
    assert got == want
    assert substrings.removed_repeats(brute.frame(spark, [])).collect() == []


def test_the_cover_is_one():
    assert substrings.is_difference_cover(substrings.COVER, substrings.PERIOD)
    assert substrings.is_difference_cover((0, 1, 4, 14, 16), 21)
    assert not substrings.is_difference_cover((0, 1, 4), 21)


def test_benchmark_items_are_found_as_in_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randint(3, 70)))) for i in range(80)] + [(80, None), (81, ""), (82, "short text")]
    rows = list(brute.AWKWARD)
    for i in range(150):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(0, 1500))]
        for _ in range(rng.randint(0, 2)):
            part = (rng.choice(items)[1] or "").split()
            part = part[: int(len(part) * rng.choice([1, 1, 0.9, 0.8, 0.6]))]
            at = rng.randint(0, len(w))
            w[at:at] = part
        rows.append((100 + i, " ".join(w)))
    want = Counter()
    sets = {i: brute.shingles(t) for i, t in items}
    for doc, text in rows:
        whole = brute.shingles(text)
        want.update((doc, i, len(s), len(s & whole)) for i, s in sets.items() if s and 100 * len(s & whole) >= 75 * len(s))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = brute.frame(spark, rows)
    for block in (8 << 20, 2000):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        assert Counter(tuple(r) for r in decontaminate.contained_items(docs, bench).collect()) == want
    clean = decontaminate.without_contaminated(docs, bench)
    assert clean.columns == docs.columns
    leaked = {d for d, *_ in want}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, _ in rows if i not in leaked)
    assert decontaminate.contained_items(docs, bench.where("item_id < 0")).collect() == []


def test_a_long_passage_is_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "_PIECE", 64)
    item = " ".join(f"i{k}" for k in range(40))
    text = " ".join([f"a{k}" for k in range(500)] + [item] + [f"b{k}" for k in range(500)])
    index = decontaminate.build_index([7], pa.array([item]))
    assert decontaminate.search(pa.array([text, None, item]), index) == [(0, 0, 36), (2, 0, 36)]


def test_words_are_cut_as_bytes_are():
    texts = [t for _, t in brute.AWKWARD] + ["a", " b", "c "]
    table = W.word_table(pa.array(texts), fold=False)
    for i, text in enumerate(texts):
        span = range(table.first[i], table.first[i + 1])
        assert [table.data[table.starts[k] : table.ends[k]].tobytes() for k in span] == brute.words(text)
    assert [len(s) for s in W.shingle_sets(pa.array(texts))] == [len(brute.shingles(t)) for t in texts]
