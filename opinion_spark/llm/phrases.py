"""Phrase collocation mining: phrases of two to five words that stand together more often than their parts would by chance.

Words are hashed (the language is part of a hash) and counted in runs, each of which has a word once. One run of those that have a
frequent word, and no other, spells it. Then texts become arrays of four-byte numbers of the frequent words, written
once; breaks that no phrase crosses, and words that are not frequent, are 0. The numbers' table has one entry per frequent word. Level by
level, phrases whose first and last words but one are frequent phrases themselves (Apriori) are proposed. Proposals are taken from the texts,
since all joins of frequent parts would grow with the square of a common word's neighbours. Most are rare, so they are counted twice: first in
buckets, whose number follows that of the words (about ``LOAD`` proposals each) and of which a task passes on no more than sorted gaps of two bytes;
then by their keys, but only those in buckets that reach ``MIN_COUNT``. Those whose sum stays below it are no candidates.

All candidates are counted by double-array tries. A trie holds at most about ``SHARD`` candidates, so its size does not grow with the
input; there are as many tries as the candidates need. Each is broadcast, every task advances the states of all its text positions
together, word by word, and adds up the states reached; the tasks' sums are added.

Scores use exact decimals. A candidate inside a longer one of the same count is dropped; since counts only fall as phrases grow, a
longer one exists exactly if one of one word more does. The best per language are taken in salted groups first, so no
language is ranked whole in one task.

Words are hashed to 64 bits. A NULL language is ``und``; NULL and empty texts have no words. Repeated rows count each. Ids and
other columns play no part. Without any frequent phrase there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinion_spark.llm import trie
from opinion_spark.llm import words as W
from opinion_spark.llm.filters import passes, sized_filter
from opinion_spark.llm.store import landed

MAX_WORDS = 5
MIN_COUNT = 100
#: Phrases returned per language.
BEST = 2000
#: Candidates of one trie, those whose sums are passed on together, and the memory of a task for words, for proposals
#: not yet summed and for sums of proposals not yet passed on.
SHARD, SUMMED_TOGETHER = 200_000, 4096
HELD_WORDS, HELD_POSITIONS, HELD_KEYS = 500_000, 200_000, 400_000
#: Proposals per bucket, about; bits of the buckets that are counted together; proposals of a task sorted together.
LOAD, RANGE_BITS, SORTED_TOGETHER = 4, 20, 400_000
#: Words of a row of numbers, about, and of the arrays that are worked on together.
ROW_WORDS, TOGETHER = 8192, 64_000

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
#: Numbers for bytes: A-Z as a-z, 0 between words.
_NUMBERS = W.byte_table({})
_NUMBERS[ord("A") : ord("Z") + 1] = _NUMBERS[ord("a") : ord("z") + 1]
_NUMBERS[list(b"\x09\x20")] = 0
_NUMBERS[_BREAKS] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def longer_keys(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases by one word more."""
    return W.mixed(keys * np.uint64(0xD6E8FEB86659FD93) + words)


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given stretches of UTF-8 bytes as strings."""
    length = ends - starts
    offsets = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], length)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[place])))


def _hashed(part: pa.RecordBatch) -> tuple[W.WordTable, np.ndarray, np.ndarray, np.ndarray]:
    """Of (lang, text): the words, their hashes with the language's part, the text of each, and where a break stands before one."""
    table = W.word_table(part.column(1), fold=True, table=_NUMBERS)
    if not len(table.hashes):
        return table, table.hashes, np.empty(0, np.int64), np.empty(0, np.int64)
    langs = part.column(0).to_pylist()
    per_text = np.diff(table.first)
    salt = {lang: _salt(lang) for lang in set(langs)}
    hashes = W.mixed(table.hashes ^ np.repeat(np.array([salt[x] for x in langs], np.uint64), per_text))
    hashes[hashes == 0] = 1
    breaks = np.cumsum(_BREAKS[table.data])[table.starts]
    text = np.repeat(np.arange(len(langs)), per_text)
    apart = np.flatnonzero((breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])) + 1
    return table, hashes, text, apart


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to words with their counts within runs; ``run`` is the run's number in the task."""
    held: list[tuple] = []
    size = run = 0

    def counted() -> pa.RecordBatch:
        key, count, lang, word = zip(*held, strict=True)
        value, at, inverse = np.unique(np.concatenate(key), return_index=True, return_inverse=True)
        total = np.bincount(inverse, np.concatenate(count)).astype(np.int64)
        picked = [pa.concat_arrays(x).take(pa.array(at)) for x in (lang, word)]
        columns = [*picked, pa.array(W.signed(value)), pa.array(total), pa.array(np.full(len(value), run))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "word", "key", "count", "run"])

    for batch in batches:
        for part in W.slices(batch, 1):
            table, hashes, text, _ = _hashed(part)
            if not len(hashes):
                continue
            value, at, count = np.unique(hashes, return_index=True, return_counts=True)
            owner = part.column(0).take(pa.array(text[at]))
            held.append((value, count, owner.cast(pa.string()), _strings(_LOWER[table.data], table.starts[at], table.ends[at])))
            size += len(value) + int((table.ends[at] - table.starts[at]).sum()) // 16
            if size > HELD_WORDS:
                yield counted()
                held, size = [], 0
                run += 1
    if held:
        yield counted()


class _Numbers(NamedTuple):
    """Frequent words: their sorted hashes, and the number of each, from one on."""

    hashes: np.ndarray
    numbers: np.ndarray

    def back(self) -> np.ndarray:
        """Hashes by number; 0 is a break."""
        out = np.zeros(len(self.hashes) + 1, np.uint64)
        out[self.numbers] = self.hashes
        return out


def _numbers(frequent: DataFrame) -> tuple[_Numbers, np.ndarray]:
    """Small numbers for frequent words, whose bytes are alike in the streams, and the run that spells each."""
    rows = frequent.select("key", "count", "run").toArrow()
    hashes = W.unsigned(rows["key"].to_numpy().astype(np.int64))
    order = np.lexsort((hashes, -rows["count"].to_numpy()))
    numbers = np.empty(len(hashes), np.uint32)
    numbers[order] = np.arange(1, len(hashes) + 1, dtype=np.uint32)
    by_value = np.argsort(hashes)
    return _Numbers(hashes[by_value], numbers[by_value]), rows["run"].to_numpy()[by_value]


def _stretches(numbers: np.ndarray) -> np.ndarray:
    """The stream without words that stand alone between breaks, and with single breaks: only phrases matter."""
    word = np.concatenate([[False], numbers != 0, [False]])
    at = np.flatnonzero(word[1:-1] & (word[:-2] | word[2:]))
    return np.insert(numbers[at], np.flatnonzero(np.diff(at) > 1) + 1, np.uint32(0))


def _numbered(shared):
    """(lang, text) to rows of word numbers, where other words than frequent ones are breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, numbers = shared.value
        for batch in batches:
            for part in W.slices(batch, 1):
                _, own, _, apart = _hashed(part)
                if not len(own):
                    continue
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                stream = _stretches(np.insert(np.where(hashes[at] == own, numbers[at], np.uint32(0)), apart, np.uint32(0)))
                if not len(stream):
                    continue
                cuts = np.flatnonzero(stream == 0)
                rows = np.split(stream, cuts[np.unique(cuts // ROW_WORDS, return_index=True)[1]])
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], ["words"])

    return run


def _streams(batches: Iterator[pa.RecordBatch], known: _Numbers) -> Iterator[np.ndarray]:
    """The rows of word numbers as hashes, joined to arrays of about ``TOGETHER`` words."""
    run, size, back = [], 0, known.back()
    for batch in batches:
        for value in batch.column(0):
            words = back[np.frombuffer(value.as_buffer(), np.uint32)]
            run += [words, np.zeros(1, np.uint64)]
            size += len(words)
            if size > TOGETHER:
                yield np.concatenate(run)
                run, size = [], 0
    if run:
        yield np.concatenate(run)


def _grams(words: np.ndarray, level: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, prefix, last) of the phrases of ``level`` words whose two parts of a word less may be frequent."""
    parts, whole = words, words != 0
    for step in range(1, level - 1):
        parts = longer_keys(parts[:-1], words[step:])
        whole = whole[:-1] & (words[step:] != 0)
    may = whole.copy()
    may[whole] = passes(bits, W.signed(parts[whole]))
    at = np.flatnonzero(may[:-1] & may[1:])
    prefix, last = parts[at], words[at + level - 1]
    return longer_keys(prefix, last), prefix, last


def _gaps(places: np.ndarray) -> bytes:
    """Sorted places as two-byte gaps; 65535 stands for as much and no end of a gap."""
    gap = np.diff(places, prepend=0)
    ends = np.cumsum(gap // 0xFFFF + 1) - 1
    out = np.full(ends[-1] + 1, 0xFFFF, np.uint16)
    out[ends] = gap % 0xFFFF
    return out.tobytes()


def _places(gaps: np.ndarray) -> np.ndarray:
    """What ``_gaps`` was given."""
    return np.cumsum(gaps, dtype=np.int64)[gaps < 0xFFFF]


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return W.signed(keys >> np.uint64(64 - bits))


def _in_buckets(level: int, bucket_bits: int, known_shared, shared):
    """Word numbers to (range, gaps): the buckets of proposed phrases by ranges of ``RANGE_BITS``. A bucket is named at most
    ``MIN_COUNT`` times at once, which is all it needs."""
    least = MIN_COUNT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = shared.value, [], 0

        def sorted_runs() -> pa.RecordBatch:
            bucket = np.sort(np.concatenate(held))
            bucket = bucket[np.concatenate([np.ones(min(least, len(bucket)), bool), bucket[least:] != bucket[:-least]])]
            of = bucket >> RANGE_BITS
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            parts = np.split(bucket & ((1 << RANGE_BITS) - 1), first[1:])
            return pa.RecordBatch.from_arrays([pa.array(of[first]), pa.array([_gaps(p) for p in parts], pa.binary())], ["range", "gaps"])

        for words in _streams(batches, known_shared.value):
            if len(words) < level:
                continue
            held.append(_buckets(_grams(words, level, bits)[0], bucket_bits))
            size += len(held[-1])
            if size > SORTED_TOGETHER:
                yield sorted_runs()
                held, size = [], 0
        if size:
            yield sorted_runs()

    return run


def _full_buckets():
    """(range, gaps), by range, to the buckets that reach ``MIN_COUNT``."""
    least = MIN_COUNT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << RANGE_BITS, np.int64)

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((now << RANGE_BITS) + np.flatnonzero(total >= least))], ["key"])

        for batch in batches:
            for of, gaps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if of != now:
                    if now is not None:
                        yield full()
                    now = of
                    total[:] = 0
                total += np.bincount(_places(np.frombuffer(gaps.as_buffer(), np.uint16)), minlength=len(total))
        if now is not None:
            yield full()

    return run


def _proposals(level: int, bucket_bits: int, known_shared, shared, full_shared):
    """Word numbers to (key, prefix, last, count) of proposed phrases in full buckets: a task's sums, passed on before its end only when
    they are of ``HELD_KEYS`` phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, full, held, size = shared.value, full_shared.value, [], 0

        def summed() -> tuple[np.ndarray, ...]:
            key, prefix, last, count = (np.concatenate(x) for x in zip(*held, strict=True))
            value, at, inverse = np.unique(key, return_index=True, return_inverse=True)
            return value, prefix[at], last[at], np.bincount(inverse, count).astype(np.int32)

        def passed_on(key: np.ndarray, prefix: np.ndarray, last: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(W.signed(x)) for x in (key, prefix, last)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(count)], ["key", "prefix", "last", "count"])

        for words in _streams(batches, known_shared.value):
            if len(words) < level:
                continue
            key, prefix, last = _grams(words, level, bits)
            some = passes(full, _buckets(key, bucket_bits))
            held.append((key[some], prefix[some], last[some], np.ones(np.count_nonzero(some), np.int32)))
            size += len(held[-1][0])
            if size > HELD_POSITIONS:
                held, size = [summed()], 0
                if len(held[0][0]) > HELD_KEYS:
                    yield passed_on(*held[0])
                    held = []
        if held:
            yield passed_on(*summed())

    return run


def _counts(known_shared, shared):
    """Word numbers to (range, counts) of one trie's phrases: the task's sums of ``SUMMED_TOGETHER`` phrases in a row, if any was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, None
        for words in _streams(batches, known_shared.value):
            found = own.visits(words, MAX_WORDS)
            total = found if total is None else total + found
        if total is not None:
            count = total[own.accepted].astype(np.int32)
            parts = [(k // SUMMED_TOGETHER, count[k : k + SUMMED_TOGETHER]) for k in range(0, len(count), SUMMED_TOGETHER)]
            some = [(of, part.tobytes()) for of, part in parts if part.any()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], kind) for k, kind in enumerate((pa.int64(), pa.binary()))], ["range", "counts"])

    return run


def _summed_counts(shared):
    """(range, counts), by range, to (key, count) of the phrases that reach ``MIN_COUNT``."""
    least = MIN_COUNT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, now, total = shared.value.keys, None, np.empty(0, np.int64)

        def reached() -> pa.RecordBatch:
            at = np.flatnonzero(total >= least)
            return pa.RecordBatch.from_arrays([pa.array(keys[now * SUMMED_TOGETHER + at]), pa.array(total[at])], ["key", "count"])

        for batch in batches:
            for of, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
                if of == now:
                    total = total + found
                else:
                    if now is not None:
                        yield reached()
                    now, total = of, found
        if now is not None:
            yield reached()

    return run


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words) to (key, size, cut, left, right): the keys of both parts for every cut."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        lists = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(1)]
        sizes = np.array([len(x) for x in lists], np.int64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            words = np.stack([lists[i] for i in own])

            def key_of(low: int, high: int, words: np.ndarray = words) -> np.ndarray:
                return reduce(lambda key, k: longer_keys(key, words[:, k]), range(low + 1, high), words[:, low])

            for cut in range(1, size):
                parts = [pa.array(W.signed(np.ascontiguousarray(key_of(*span)))) for span in ((0, cut), (cut, size))]
                fixed = [pa.array(np.full(len(own), x, np.int32)) for x in (size, cut)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[own]), *fixed, *parts], ["key", "size", "cut", "left", "right"])


def _spelled(shared):
    """(key, lang, word, run) to (key, lang, word) of every frequent word once, from the run that spells it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, runs = shared.value
        for batch in batches:
            own = W.unsigned(batch.column(0).to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            some = (hashes[at] == own) & (runs[at] == batch.column(3).to_numpy(zero_copy_only=False))
            yield batch.select([0, 1, 2]).filter(pa.array(some))

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, word) with the word as a phrase: its hash as bytes."""
    for batch in batches:
        hashes = [key.to_bytes(8, "little", signed=True) for key in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.binary())], ["key", "lang", "phrase", "words"])


def _candidates(streams: DataFrame, spelled: DataFrame, known_shared, spark) -> list[DataFrame]:
    """Per number of words, from two on: (key, lang, phrase, words) of the proposals that reach the least count."""
    words = landed(spelled.mapInArrow(_single, "key long, lang string, phrase string, words binary"))
    levels, known = [], words
    stream_bytes = streams.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    bucket_bits = max(RANGE_BITS, int(stream_bytes // (4 * LOAD)).bit_length())
    for level in range(2, MAX_WORDS + 1):
        if known.isEmpty():
            break
        shared = spark.sparkContext.broadcast(sized_filter(known))
        named = streams.mapInArrow(_in_buckets(level, bucket_bits, known_shared, shared), "range long, gaps binary")
        full = landed(named.repartition("range").sortWithinPartitions("range").mapInArrow(_full_buckets(), "key long"))
        full_shared = spark.sparkContext.broadcast(sized_filter(full))
        proposed = streams.mapInArrow(
            _proposals(level, bucket_bits, known_shared, shared, full_shared), "key long, prefix long, last long, count int"
        )
        sums = proposed.groupBy("key").agg(F.sum("count").alias("seen"), F.min("prefix").alias("prefix"), F.min("last").alias("last"))
        safe = landed(sums.where(F.col("seen") >= MIN_COUNT).select("key", "prefix", "last"))
        for used in (shared, full_shared):
            used.destroy()
        before = known.select(F.col("key").alias("prefix"), "lang", F.col("phrase").alias("start"), F.col("words").alias("start_words"))
        after = words.select(F.col("key").alias("last"), F.col("phrase").alias("end"), F.col("words").alias("end_words"))
        known = landed(
            safe.join(before, "prefix")
            .join(after, "last")
            .select("key", "lang", F.concat_ws(" ", "start", "end").alias("phrase"), F.concat("start_words", "end_words").alias("words"))
        )
        levels.append(known)
    return levels


def _frequencies(streams: DataFrame, phrases: DataFrame, known_shared, spark) -> DataFrame:
    """(key, count) of all phrases, trie by trie."""
    shards = -(-phrases.count() // SHARD)
    parts = []
    for shard in range(shards):
        own = phrases.where(F.pmod("key", F.lit(shards)) == shard).select("key", "words").toArrow()
        rows = np.zeros((own.num_rows, MAX_WORDS), np.uint64)
        for row, value in zip(rows, own["words"].to_pylist(), strict=True):
            row[: len(value) // 8] = np.frombuffer(value, np.uint64)
        shared = spark.sparkContext.broadcast(trie.build(rows, own["key"].to_numpy()))
        sums = streams.mapInArrow(_counts(known_shared, shared), "range long, counts binary").repartition("range").sortWithinPartitions("range")
        parts.append(landed(sums.mapInArrow(_summed_counts(shared), "key long, count long")))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The best phrases per language: ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (those of the parts at the cut
    that counts), ``n`` (words of the language), ``score``, ``cut``."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text).cast("string"))
    counted = source.mapInArrow(_word_counts, "lang string, word string, key long, count long, run long")
    # A run's number in all: its task's, and its own within the task.
    counted = landed(counted.withColumn("run", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("run")))
    totals = landed(counted.groupBy("lang").agg(F.sum("count").alias("n")))
    sums = counted.groupBy("key").agg(F.sum("count").alias("count"), F.min("run").alias("run"))
    frequent = landed(sums.where(F.col("count") >= MIN_COUNT))
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long, cut int"
    if frequent.isEmpty():
        return spark.createDataFrame([], schema)
    known, runs = _numbers(frequent)
    shared = spark.sparkContext.broadcast((known.hashes, runs))
    spelled = landed(counted.select("key", "lang", "word", "run").mapInArrow(_spelled(shared), "key long, lang string, word string"))
    shared.destroy()
    known_shared = spark.sparkContext.broadcast(known)
    streams = landed(source.mapInArrow(_numbered(known_shared), "words binary"))
    levels = _candidates(streams, spelled, known_shared, spark)
    if not levels or levels[0].isEmpty():
        return spark.createDataFrame([], schema)
    phrases = landed(reduce(DataFrame.unionByName, levels))
    counts = _frequencies(streams, phrases, known_shared, spark)
    known_shared.destroy()
    all_counts = landed(counts.unionByName(frequent.select("key", "count")))
    named = landed(phrases.join(counts.withColumnRenamed("count", "a"), "key").join(totals, "lang").select("key", "lang", "phrase", "a", "n", "words"))
    cuts = landed(named.select("key", "words").mapInArrow(_cuts, "key long, size int, cut int, left long, right long"))
    own = named.select("key", "a", "n")
    # A phrase of one word less is the left part of the last cut and the right part of the first.
    inside = cuts.where("size > 2 and cut = size - 1").select("key", F.col("left").alias("part"))
    inside = inside.unionByName(cuts.where("size > 2 and cut = 1").select("key", F.col("right").alias("part")))
    longer = landed(inside.join(own.select("key", "a"), "key").groupBy("part").agg(F.max("a").alias("longer")))
    left = all_counts.select(F.col("key").alias("left"), F.col("count").alias("l"))
    right = all_counts.select(F.col("key").alias("right"), F.col("count").alias("r"))
    wide = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "n", "l", "r")}
    parted = cuts.select("key", "cut", "left", "right").join(left, "left").join(right, "right").join(own, "key")
    parted = parted.select("key", "cut", "l", "r", (F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"]).alias("above"), (wide["l"] * wide["r"]).alias("below"))
    scored = parted.select("key", F.struct(F.expr("above div below").alias("score"), "cut", "l", "r").alias("s"))
    lowest = landed(scored.groupBy("key").agg(F.min("s").alias("s")))
    kept = (
        named.drop("words")
        .join(longer.withColumnRenamed("part", "key"), "key", "left")
        .where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
        .join(lowest, "key")
        .select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score", "s.cut", F.pmod("key", F.lit(64)).alias("salt"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= BEST)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= BEST)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
