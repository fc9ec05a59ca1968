"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

A MinHash of a whole long document says nothing about a short passage. Items are therefore partitioned by the size
of their shingle sets; for a partition with sizes up to ``u`` a document is read as overlapping windows of ``2 u``
shingles, ``u`` apart, so that any passage of an item's length lies whole in one window and the sizes compared
differ by a bounded factor. Window and item get a one-permutation MinHash: the hash range is cut into bins and each
bin keeps its least hash; equal minima in any bin make the item a candidate. The number of bins of a partition is
chosen so that a passage with the required share of the item's shingles is missed with a probability of at most
``MISS``. Candidates are verified exactly: the share of the item's shingles that the whole document contains.

The items are a stated query set that is held against all documents in blocks of bounded bytes; a task holds one
block's index and the join needs no shuffle of documents.

NULL or blank texts, on either side, contain nothing and are contained in nothing. An item below five words is one
shingle (its whole sequence) and is found only as a whole document. Equal items are reported each, repeated
documents each; ``item_id`` and ``doc_id`` are only carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.llm import words as W

#: Least share of an item's shingles, in hundredths.
PERCENT = 75
#: Chance at most that a passage with just the least share has no bin in common.
MISS = 1e-4
#: Bytes of item text whose index a task holds at once.
BLOCK_BYTES = 8 << 20

_VALUE_BITS = 40
_PIECE = 1 << 22


class Partition(NamedTuple):
    upper: int
    bits: int
    keys: np.ndarray
    first: np.ndarray
    items: np.ndarray


class Index(NamedTuple):
    ids: list
    sets: list[np.ndarray]
    partitions: list[Partition]


def bin_bits(lower: int, upper: int) -> int:
    """Bits of the number of bins for items of ``lower`` to ``upper`` shingles in windows of twice ``upper``.

    A shared shingle fails to be the least of its bin in both sets with a chance of at most ``3 u / (2 m)``.
    """
    shared = math.ceil(PERCENT * lower / 100)
    return min(24, math.ceil(math.log2(1.5 * upper * MISS ** (-1 / shared))))


def _least_per_bin(keys: np.ndarray, bits: int) -> np.ndarray:
    """Of keys (set number, hash), the least of every set and bin."""
    keys = np.sort(keys)
    group = keys >> np.uint64(_VALUE_BITS - bits)
    return keys[np.concatenate([[True], group[1:] != group[:-1]])] if len(keys) else keys


def _value(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - _VALUE_BITS)


def build_index(ids: list, texts: pa.Array) -> Index:
    sets = list(W.shingle_sets(texts))
    size = np.array([len(s) for s in sets])
    partitions, upper = [], 1
    while upper // 2 < size.max(initial=0):
        lower = upper // 2 + 1
        chosen = np.flatnonzero((size >= lower) & (size <= upper))
        if len(chosen):
            bits = bin_bits(lower, upper)
            found = [_least_per_bin(_value(sets[i]), bits) for i in chosen]
            keys, owner = np.concatenate(found), np.repeat(chosen, [len(f) for f in found])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            partitions.append(Partition(upper, bits, keys[start], np.append(start, len(keys)), owner))
        upper *= 2
    return Index(ids, sets, partitions)


def _candidates(lists: list[np.ndarray], part: Partition) -> set[tuple[int, int]]:
    """(document, item) pairs with a common bin minimum in some window."""
    u = part.upper
    pieces = [(d, x[i : i + _PIECE + 2 * u]) for d, x in enumerate(lists) for i in range(0, len(x), _PIECE)]
    if not pieces:
        return set()
    length = np.array([len(x) for _, x in pieces])
    blocks = -(-length // u)
    base = np.concatenate([[0], np.cumsum(blocks)])
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    block = np.repeat(base[:-1], length) + place // u
    shift = np.uint64(_VALUE_BITS)
    keys = (block.astype(np.uint64) << shift) | _value(np.concatenate([x for _, x in pieces]))
    least = _least_per_bin(keys, part.bits)
    opens = np.zeros(base[-1] + 1, bool)
    opens[base[:-1]] = True
    with_next = least[~opens[(least >> shift).astype(np.int64)]] - (np.uint64(1) << shift)
    windows = _least_per_bin(np.concatenate([least, with_next]), part.bits)
    value = windows & np.uint64((1 << _VALUE_BITS) - 1)
    at = np.minimum(np.searchsorted(part.keys, value), len(part.keys) - 1)
    hit = part.keys[at] == value
    owner = np.repeat(np.array([d for d, _ in pieces]), blocks)
    docs = owner[(windows[hit] >> shift).astype(np.int64)]
    return {(int(d), int(i)) for d, k in zip(docs, at[hit], strict=True) for i in part.items[part.first[k] : part.first[k + 1]]}


def search(texts: pa.Array, index: Index) -> list[tuple[int, int, int]]:
    """(document number, item number, shared shingles) of verified pairs."""
    lists = list(W.shingle_lists(texts))
    found = set().union(*(_candidates(lists, part) for part in index.partitions))
    out, last, whole = [], -1, None
    for doc, item in sorted(found):
        if doc != last:
            last, whole = doc, W.distinct(lists[doc])
        wanted = index.sets[item]
        at = np.minimum(np.searchsorted(whole, wanted), len(whole) - 1)
        shared = int((whole[at] == wanted).sum())
        if 100 * shared >= PERCENT * len(wanted):
            out.append((doc, item, shared))
    return out


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    """The items' indexes, block by block; a block is fetched when it is needed."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    number = F.pmod(F.xxhash64(F.col(item_id), F.col(text)), F.lit(n)) if n else None
    for k in range(n):
        block = items.where(number == k).select(F.col(item_id).alias("id"), F.col(text).alias("text")).toArrow()
        index = build_index(block["id"].to_pylist(), block["text"].combine_chunks())
        if index.partitions:
            yield index


def contained_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """A row for each document and item it contains: ``doc_id``, ``item_id``, ``n_item`` (the item's shingles) and
    ``n_shared`` (those that the document has)."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    out = spark.createDataFrame([], schema)
    for index in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in W.slices(batch, 1):
                    found = search(part.column(1), index)
                    if not found:
                        continue
                    docs, items, n_shared = zip(*found, strict=True)
                    columns = [
                        part.column(0).take(pa.array(docs)),
                        pa.array([index.ids[i] for i in items], pa.int64()),
                        pa.array([len(index.sets[i]) for i in items], pa.int64()),
                        pa.array(n_shared, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_item", "n_shared"])

        out = out.unionByName(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema))
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay as they are, no row is shuffled."""
    place = [c.lower() for c in docs.columns].index(text.lower())
    for index in _blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in W.slices(batch, place):
                    clean = np.ones(part.num_rows, bool)
                    clean[[doc for doc, _, _ in search(part.column(place), index)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
