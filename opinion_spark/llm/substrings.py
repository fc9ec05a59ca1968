"""Substring dedup of word windows, with difference-cover anchors.

A word is removed where it lies in a window of ``WIDTH`` words whose sequence also starts anywhere else. Instead of every
position, only positions whose number modulo ``PERIOD`` is in a difference cover are hashed, with windows of ``WIDTH - PERIOD + 1`` words.
Any two positions have a common shift below PERIOD that puts both on the cover, so two equal windows of WIDTH words
hold equal anchors at the same distance. Anchors that occur once are gone after one shuffle; the others extend to
the windows that hold them, and only those are hashed whole and compared in a second shuffle.

Occurrences are combined where they are made: of a hash that repeats within a task's run, one row is shuffled. So a
shuffled hash has at most one row per run, however often it occurs. No pairs are formed, all steps are linear in the words.

NULL and blank texts have no words. Repeated rows are separate documents, so each is a copy of the other. Rows are
identified by a hash of id and text; NULL ids and other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.llm import words as W
from opinion_spark.llm.filters import key_filter, passes
from opinion_spark.llm.store import landed, row_key

WIDTH = 35
#: A perfect difference set: every number modulo 13 is a difference of two of its elements.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Occurrences are combined in runs of about so many.
RUN_ROWS = 1_000_000

#: A place below -1 is a known one: -2 minus the place.
_OCCURRENCES = "hash long, key long, at long"


def is_difference_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _combined(runs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(hash, key, at) arrays to occurrences: those that repeat within a run are known, with a row at -1 to say so."""

    def made(held: list) -> pa.RecordBatch:
        h, key, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, key, at = h[order], key[order], at[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(h)))
        known = np.repeat(size > 1, size)
        mark = h[start[size > 1]]
        columns = [
            np.concatenate([h, mark]),
            np.concatenate([key, np.zeros(len(mark), np.int64)]),
            np.concatenate([np.where(known, -2 - at, at), np.full(len(mark), -1)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "key", "at"])

    held, rows = [], 0
    for run in runs:
        held.append(run)
        rows += len(run[0])
        if rows >= RUN_ROWS:
            yield made(held)
            held, rows = [], 0
    if rows:
        yield made(held)


def _anchors(cover: tuple[int, ...], period: int, width: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        on = np.isin(np.arange(period), cover)
        for batch in batches:
            for part in W.slices(batch, 1):
                table = W.word_table(part.column(1), fold=False)
                hashes = W.window_hashes(table.hashes, width)
                if not len(hashes):
                    continue
                count = np.diff(table.first)
                doc = np.repeat(np.arange(len(count)), count)[: len(hashes)]
                at = np.arange(len(hashes)) - table.first[doc]
                keep = (at + width <= count[doc]) & on[at % period]
                key = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield W.signed(hashes[keep]), key[doc[keep]], at[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _combined(runs(batches))

    return run


def _places(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int64)


def _windows(period: int, width: int):
    """(row, text, anchor places) to whole windows around the anchors."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for part in W.slices(batch, 1):
                table = W.word_table(part.column(1), fold=False)
                for i, key in enumerate(part.column(0).to_pylist()):
                    low, high = int(table.first[i]), int(table.first[i + 1])
                    last = high - low - width
                    if last < 0:
                        continue
                    anchors = _places(part.column(2)[i])
                    edge = np.zeros(last + 2 + period, np.int64)
                    np.add.at(edge, np.maximum(anchors - period + 1, 0), 1)
                    np.add.at(edge, np.minimum(anchors + 1, last + 1), -1)
                    at = np.flatnonzero(np.cumsum(edge[: last + 1]) > 0)
                    if len(at):
                        hashes = W.window_hashes(table.hashes[low:high], width)
                        yield W.signed(hashes[at]), np.full(len(at), key, np.int64), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _combined(runs(batches))

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by hash to the (key, at) of hashes that occur twice or more."""

    def made(key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(at)], ["key", "at"])

    def closed(h, key, at):
        size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h)))
        start = np.cumsum(size) - size
        several = (size > 1) | (at[start] < 0)
        keep = np.repeat(several, size) & (at >= 0)
        return made(key[keep], at[keep])

    rest = [np.empty(0, np.int64)] * 3
    for batch in batches:
        h, key, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        known = at < -1
        if known.any():
            yield made(key[known], -2 - at[known])
        h, key, at = (np.concatenate([old, new[~known]]) for old, new in zip(rest, (h, key, at), strict=True))
        cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
        if cut:
            yield closed(h[:cut], key[:cut], at[:cut])
        rest = [h[cut:], key[cut:], at[cut:]]
    if len(rest[0]):
        yield closed(*rest)


def _repeated(occurrences: DataFrame) -> DataFrame:
    """``key`` and its sorted places ``at`` (eight bytes each) of hashes that occur twice or more.

    Known occurrences are dealt by key, the others by hash; places of a row come together at the end.
    """
    dealt = F.when(F.col("at") < -1, F.xxhash64("key", "at")).otherwise(F.col("hash"))
    places = occurrences.repartition(dealt).sortWithinPartitions("hash").mapInArrow(_several, "key long, at long")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.array(v, np.int64).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary())], ["key", "at"])

    lists = places.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("at"))
    return lists.mapInArrow(packed, "key long, at binary")


def _kept(width: int):
    """(key, text, starts of repeated windows) to (key, n_removed, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, 1):
                removed, digest = [], []
                for text, starts in zip(W.utf8(part.column(1)), part.column(2), strict=True):
                    words = text.split()
                    edge = np.zeros(len(words) + width + 1, np.int64)
                    at = _places(starts)
                    edge[at] += 1
                    edge[at + width] -= 1
                    gone = np.cumsum(edge[: len(words)]) > 0
                    removed.append(int(gone.sum()))
                    digest.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed, pa.int64()), pa.array(digest)], ["key", "n_removed", "kept_sha256"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) to (id, key, n_words, hash of all words)."""
    for batch in batches:
        for part in W.slices(batch, 2):
            words = [t.split() for t in W.utf8(part.column(2))]
            counts = pa.array([len(w) for w in words], pa.int64())
            digests = pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts, digests], ["doc_id", "key", "n_words", "whole"])


def removed_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, cover: tuple[int, ...] = COVER, period: int = PERIOD
) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` (of the kept words joined by one space)."""
    if not is_difference_cover(cover, period) or width < period:
        raise ValueError("no difference cover, or a window shorter than the period")
    key = row_key(F.col(doc_id), F.col(text)).alias("key")
    keyed = docs.select(key, F.col(text).cast("string").alias("text"))
    anchors = landed(_repeated(keyed.mapInArrow(_anchors(cover, period, width - period + 1), _OCCURRENCES)))
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(anchors))

    def with_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))

    keyed = keyed.mapInArrow(with_anchors, keyed.schema)
    # Small row numbers stand for the keys from here on: they compress, as most rows of a shuffle are windows.
    candidates = landed(keyed.join(anchors, "key").select("key", "text", "at", F.monotonically_increasing_id().alias("row")))
    windows = _repeated(candidates.select("row", "text", "at").mapInArrow(_windows(period, width), _OCCURRENCES))
    found = candidates.drop("at").join(windows.withColumnRenamed("key", "row"), "row").select("key", "text", "at")
    changed = found.mapInArrow(_kept(width), "key long, n_removed long, kept_sha256 string").dropDuplicates(["key"])
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key, F.col(text).cast("string")).mapInArrow(
        _whole, "doc_id long, key long, n_words long, whole string"
    )
    return whole.join(landed(changed), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )
