"""Manifest, chosen-path join and phrases against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from test_pairs import near_copies

from opinion_spark.llm import chosen_path, classifier, manifest, phrases, trie
from opinion_spark.llm import words as W


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def expected_proofs(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""

    def leaf(row, more=0):
        values = list(row)
        if values[3] is not None:
            values[3] += more
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
    trees = {name: levels([leaf(r) for r in groups[name]]) for name in names}
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            path = []
            for tree, k in ((trees[name], at), (top, place)):
                for level in tree[:-1]:
                    path.append((level[k ^ 1] if k ^ 1 < len(level) else None, bool(k & 1)))
                    k >>= 1
            node = leaf(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for other, left in path:
                node = h(node) if other is None else h(other, node) if left else h(node, other)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[name][-1][0], root, h(*(o for o, _ in path if o)), node, node == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank long, digest string"


def proofs_of(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return manifest.proofs(manifest.document_manifest(docs), with_proof=True)


def test_proofs_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**9), rng.choice(["a", None]), rng.choice(["en", "de", "ü", None]), rng.choice([None, 5]), "t" * (i % 9)) for i in range(900)]
    rows += [(7, "a", "one", None, None)] + [(None, None, "en", 1, "é")] * 2 + [(5, "s", "en", 3, "same")] * 300
    found = proofs_of(spark, rows).collect()
    assert Counter(tuple(r)[:7] for r in found) == Counter(expected_proofs(rows))
    for r in found:  # the proof itself is enough to verify
        assert h(*(p[2:] for p in r["proof"])) == r["proof_sha256"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 256, 257, 513])
def test_trees_of_any_size(spark, n):
    rows = [(i, "s", "en", i, "x") for i in range(n)]
    assert Counter(tuple(r)[:7] for r in proofs_of(spark, rows).collect()) == Counter(expected_proofs(rows) if n else [])


def test_chosen_paths_find_all_links(spark):
    rows = brute.AWKWARD + near_copies(5)
    found = chosen_path.deduplicated(brute.frame(spark, rows)).collect()
    assert Counter(tuple(r)[:3] for r in found) == Counter(brute.linked(rows, 85))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert chosen_path.deduplicated(brute.frame(spark, [])).collect() == []


def test_large_nodes_are_split(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 6)
    monkeypatch.setattr(chosen_path, "FEW", 4)
    rows = near_copies(7, 90)
    found = chosen_path.deduplicated(brute.frame(spark, rows, extra=False)).collect()
    assert Counter(tuple(r)[:3] for r in found) == Counter(brute.linked(rows, 85))


def best_phrases(rows, least, best):
    counts = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        kept = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        gone = {q[i : i + k] for q, v in kept.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if v >= kept[q[i : i + k]]}
        rows = []
        for p in kept.keys() - gone:
            score, cut = min((1000 * kept[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -kept[p], " ".join(p).encode(), f[p[:cut]], f[p[cut:]], cut))
        out += [(lang, r, p.decode(), -a, x, y, n, -s, c) for r, (s, a, p, x, y, c) in enumerate(sorted(rows)[:best], 1)]
    return out


def test_phrases_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_COUNT", 6)
    monkeypatch.setattr(phrases, "BEST", 60)
    monkeypatch.setattr(phrases, "SHARD", 40)
    monkeypatch.setattr(phrases, "HELD_WORDS", 300)
    monkeypatch.setattr(phrases, "HELD_POSITIONS", 500)
    monkeypatch.setattr(phrases, "ROW_WORDS", 50)
    rng = random.Random(9)
    words = ["the", "The", "of", "é", "x y", "longword" * 9] + [f"w{i}" for i in range(25)]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) for _ in range(rng.randrange(80)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, " ,;. "), ("fr", "one phrase that only repeats " * 9)] + [("en", "copy of this text. " * 4)] * 5
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, rank long, KEY string")
    found = phrases.collocations(docs).collect()
    assert Counter(map(tuple, found)) == Counter(best_phrases(rows, 6, 60))
    assert phrases.collocations(docs.where("lang = 'none'")).collect() == []


def test_streams_hold_numbers_of_frequent_words(monkeypatch):
    numbers = np.array([0, 3, 0, 4, 5, 0, 0, 6, 1, 2, 0, 7], np.uint32)
    assert phrases._stretches(numbers).tolist() == [4, 5, 0, 6, 1, 2]
    assert phrases._stretches(numbers[:3]).tolist() == [] and phrases._stretches(numbers[3:5]).tolist() == [4, 5]

    class Shared:
        pass

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["Of the rare of the. of", None, "the of the, the of, rare"])], ["lang", "text"])
    counted = [row for b in phrases._word_counts(iter([batch])) for row in b.to_pylist()]
    some = sorted((r for r in counted if r["word"] != "rare"), key=lambda r: r["key"] % (1 << 64))
    hashes = np.array([r["key"] for r in some], np.int64).view(np.uint64)
    Shared.value = phrases._Numbers(hashes, np.array([1, 2], np.uint32))
    monkeypatch.setattr(phrases, "ROW_WORDS", 4)
    rows = [v.as_py() for b in phrases._numbered(Shared)(iter([batch])) for v in b.column(0)]
    name = {k: r["word"] for k, r in enumerate(some, 1)} | {0: "."}
    assert " ".join(name[n] for n in np.frombuffer(b"".join(rows), np.uint32)) == "of the . of the . the of the . the of"
    back = np.concatenate(list(phrases._streams(iter([pa.RecordBatch.from_arrays([pa.array(rows)], ["words"])]), Shared.value)))
    assert set(back.tolist()) == {0, *hashes.tolist()}


def test_trie_counts_every_phrase():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 1 << 62, 30).astype(np.uint64)
    text = words[rng.integers(0, 30, 4000)]
    text[rng.random(4000) < 0.1] = 0
    found = Counter(tuple(text[i : i + k].tolist()) for k in range(2, 6) for i in range(4000 - k + 1) if (text[i : i + k] != 0).all())
    some = sorted(found)[::3]
    table = np.zeros((len(some), 5), np.uint64)
    for row, phrase in zip(table, some, strict=True):
        row[: len(phrase)] = phrase
    own = trie.build(table, np.arange(len(some)))
    assert own.visits(text, 5)[own.accepted].tolist() == [found[p] for p in some]
    assert trie.build(table[:0], np.arange(0)).visits(text, 5).tolist() == [0]


def test_classifier_without_labels_or_documents(spark):
    docs = brute.frame(spark, [(1, "some words"), (2, None), (2, None)])
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    for rows, n in ((docs, 3), (docs.where("doc_id < 0"), 0)):
        model = classifier.trained(classifier.labelled_sample(rows, labels), label="label")
        assert [(r["score"], r["predicted"]) for r in classifier.scored(rows, model).collect()] == [(0.5, 1)] * n


def test_rare_proposals_leave_a_task_as_two_bytes(monkeypatch):
    """Buckets of any gap come back, a bucket in every run counts in full, and only proposals of full buckets are given by key."""
    places = np.array([0, 0, 3, 65534, 131069, 131069, 1_000_000], np.int64)
    assert phrases._places(np.frombuffer(phrases._gaps(places), np.uint16)).tolist() == places.tolist()
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(1, 1 << 63, 3000, dtype=np.uint64))
    numbers = rng.integers(1, len(hashes) + 1, 120_000).astype(np.uint32)
    numbers[np.arange(0, 120_000, 1000)[:, None] + np.arange(2)] = [7, 8]  # one pair 120 times, the others hardly twice

    class Known:
        value = phrases._Numbers(hashes, np.arange(1, len(hashes) + 1, dtype=np.uint32))

    class All:
        value = np.full(1 << 17, 255, np.uint8)

    rows = [numbers[k : k + 6000].tobytes() for k in range(0, 120_000, 6000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["words"])]
    monkeypatch.setattr(phrases, "SORTED_TOGETHER", 50_000)
    bits = phrases.RANGE_BITS
    named = list(phrases._in_buckets(2, bits, Known, All)(iter(batches)))
    assert len(named) > 1
    assert sum(len(v.as_py()) for b in named for v in b.column(1)) < 2.2 * 120_000
    full = np.concatenate([b.column(0).to_numpy() for b in phrases._full_buckets()(iter(named))])
    word = [hashes[6], hashes[7]]
    key = phrases.longer_keys(np.array(word[:1]), np.array(word[1:]))
    assert full.tolist() == phrases._buckets(key, bits).tolist()

    class Full:
        value = np.zeros(1 << 17, np.uint8)

    Full.value[full >> 3] |= (1 << (full & 7)).astype(np.uint8)
    found = [r for b in phrases._proposals(2, bits, Known, All, Full)(iter(batches)) for r in b.to_pylist()]
    assert sum(r["count"] for r in found if r["key"] == key.view(np.int64)[0]) == 120
    assert {(r["prefix"], r["last"]) for r in found if r["key"] == key.view(np.int64)[0]} == {tuple(np.array(word).view(np.int64).tolist())}
    assert sum(r["count"] for r in found) < 200


@pytest.mark.parametrize("held", [10_000, 20])
def test_a_task_sums_its_proposals_up(monkeypatch, held):
    """A phrase that comes again and again leaves a task in one row, and in more only where sums get too large to hold."""
    monkeypatch.setattr(phrases, "HELD_POSITIONS", 1000)
    monkeypatch.setattr(phrases, "HELD_KEYS", held)
    monkeypatch.setattr(phrases, "TOGETHER", 300)
    rng = np.random.default_rng(6)
    hashes = np.unique(rng.integers(1, 1 << 63, 12, dtype=np.uint64))
    numbers = rng.integers(0, len(hashes) + 1, (60, 200)).astype(np.uint32)

    class Known:
        value = phrases._Numbers(hashes, np.arange(1, len(hashes) + 1, dtype=np.uint32))

    class All:
        value = np.full(1 << 17, 255, np.uint8)

    batches = [pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in part], pa.binary())], ["words"]) for part in np.split(numbers, 6)]
    found = [r for b in phrases._proposals(2, phrases.RANGE_BITS, Known, All, All)(iter(batches)) for r in b.to_pylist()]
    expected, back = Counter(), Known.value.back()
    for row in numbers:
        some = (row[:-1] != 0) & (row[1:] != 0)
        expected.update(zip(*(W.signed(back[x[some]]).tolist() for x in (row[:-1], row[1:])), strict=True))
    sums = Counter()
    for r in found:
        sums[r["prefix"], r["last"]] += r["count"]
        assert r["key"] == int(W.signed(phrases.longer_keys(*(np.array([r[x]], np.int64).view(np.uint64) for x in ("prefix", "last"))))[0])
    assert sums == expected
    assert (len(found) == len(expected)) == (held > len(expected))


def test_frequent_words_are_spelled_once(spark, monkeypatch):
    """The step that gives frequent words their letters makes a row per word, not one per word and task."""
    monkeypatch.setattr(phrases, "MIN_COUNT", 6)
    rows = [(lang, f"Some words stand in every text, as these do in number {i}") for i in range(90) for lang in ("en", None)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    expected = best_phrases(rows, 6, phrases.BEST)
    made, plain = spark.sparkContext.accumulator(0), type(docs).mapInArrow

    def watched(frame, func, schema, *more):
        def run(batches):
            for batch in func(batches):
                made.add(batch.num_rows)
                yield batch

        return plain(frame, run if schema == "key long, lang string, word string" else func, schema, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    assert Counter(map(tuple, phrases.collocations(docs).collect())) == Counter(expected)
    assert made.value == 2 * len(set("some words stand in every text as these do in number".split()))


def test_one_run_of_a_task_spells_a_word(monkeypatch):
    monkeypatch.setattr(phrases, "HELD_WORDS", 3)
    texts = ["a b c d", "a b e", "rare a", None, "E b f"]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text], pa.string())], ["lang", "text"]) for text in texts]
    counted = list(phrases._word_counts(iter(batches)))
    rows = [row for batch in counted for row in batch.to_pylist()]
    assert sorted({row["run"] for row in rows}) == list(range(len(counted))) and len(counted) > 2
    assert len({(row["key"], row["run"]) for row in rows}) == len(rows)
    first = {}
    for row in rows:
        if row["word"] in "abe":
            first.setdefault(row["key"] % (1 << 64), (row["run"], row["word"]))

    class Shared:
        value = np.array(sorted(first), np.uint64), np.array([first[key][0] for key in sorted(first)])

    found = [row for batch in phrases._spelled(Shared)(b.select(["key", "lang", "word", "run"]) for b in counted) for row in batch.to_pylist()]
    assert Counter((row["key"] % (1 << 64), row["word"]) for row in found) == Counter((key, word) for key, (_, word) in first.items())


def test_tasks_pass_on_the_counts_of_a_trie_in_few_rows():
    rng = np.random.default_rng(5)
    hashes = np.unique(rng.integers(1, 1 << 63, 200, dtype=np.uint64))

    class Known:
        value = phrases._Numbers(hashes, np.arange(1, len(hashes) + 1, dtype=np.uint32))

    pairs = np.array([[a, b, 0, 0, 0] for a in hashes[:100] for b in hashes[:100]], np.uint64)
    keys = phrases.longer_keys(pairs[:, 0], pairs[:, 1]).view(np.int64)

    class Tries:
        value = trie.build(pairs, keys)

    tasks = [rng.integers(1, 101, 150_000).astype(np.uint32) for _ in range(8)]
    expected = Counter()
    rows = []
    for numbers in tasks:
        words = hashes[numbers - 1]
        expected.update(phrases.longer_keys(words[:-1], words[1:]).view(np.int64).tolist())
        batch = pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()], pa.binary())], ["words"])
        own = [r for b in phrases._counts(Known, Tries)(iter([batch])) for r in b.to_pylist()]
        assert 0 < len(own) <= -(-len(keys) // phrases.SUMMED_TOGETHER)
        rows += own
    rows.sort(key=lambda r: r["range"])
    batch = pa.RecordBatch.from_arrays([pa.array([r["range"] for r in rows]), pa.array([r["counts"] for r in rows])], ["range", "counts"])
    found = {r["key"]: r["count"] for b in phrases._summed_counts(Tries)(iter([batch])) for r in b.to_pylist()}
    assert found == {k: n for k, n in expected.items() if n >= phrases.MIN_COUNT}


def test_the_pipeline_asks_for_batches_that_suit_whole_texts(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for asked, got in (("10000", 1024), ("0", 1024), ("300", 300)):
            spark.conf.set(name, asked)
            corpus_pipeline._small_batches(spark)
            assert int(spark.conf.get(name)) == got
    finally:
        spark.conf.set(name, before)


def test_landed_tables_are_compressed_well(spark):
    from opinion_spark.llm.store import landed

    found = landed(spark.createDataFrame([(i, "text " * i) for i in range(50)], "id long, text string"))
    assert found.count() == 50
    assert found.inputFiles() and all(f.endswith(".zstd.parquet") for f in found.inputFiles())
