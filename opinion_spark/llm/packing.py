"""Best-two-fit packing of documents into sequences of at most ``CAPACITY`` tokens.

A sequence is filled greedily with the longest piece that fits; then its smallest piece is taken out and replaced by
two unpacked pieces that fill the widened gap more tightly, as long as that helps. Pieces of one length are
interchangeable, so the decisions depend only on how many pieces of each length there are: a histogram of at most
``CAPACITY`` numbers, whatever the input. Equal sequences are decided once, as a pattern with a multiplicity.
The pieces then find their places in parallel: a piece's rank among those of its length (counted in salted groups, so
no length is a hot key) selects the pattern slot. Every piece is placed exactly once.

A NULL text is empty and still has its end token. Repeated rows are packed each. Ids and other columns are only carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinion_spark.llm import words as W
from opinion_spark.llm.store import landed
from opinion_spark.llm.tokens import shortcut, tokenizer_path

CAPACITY = 4096
END_TOKEN = 1
#: Pieces of one length are ranked in groups of about so many.
RANKED_TOGETHER = 200_000


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenised documents, each followed by the end token, cut into pieces of CAPACITY tokens."""
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    end = END_TOKEN.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shortcut(path).ids
        for batch in batches:
            for part in W.slices(batch, 1):
                rows = []
                for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(value or "") + end
                    for piece, start in enumerate(range(0, len(ids), 4 * CAPACITY)):
                        own = ids[start : start + 4 * CAPACITY]
                        rows.append((key, piece, start // 4, len(own) // 4, zlib.crc32(own)) + (own,) * with_ids)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, schema)


def _widened(lengths: list[int], left: dict[int, int], smallest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest in (smallest, room], the first the longer."""
    best, found = smallest, None
    low, high = 0, bisect_right(lengths, room) - 1
    while low <= high:
        a, b = lengths[high], lengths[low]
        total = a + b
        if total > room or left[a] < 1 or (low == high and left[a] < 2):
            high -= 1
        elif left[b] < 1:
            low += 1
        else:
            if total > best:
                best, found = total, (a, b)
                if best == room:
                    break
            low += 1
    return found


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, {length: pieces of it in each}) for so many pieces of each length."""
    counts = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(counts)
    out = []
    while lengths:
        chosen: dict[int, int] = {}
        room, below = capacity, len(lengths)
        while room and (below := min(below, bisect_right(lengths, room))):
            below -= 1
            n = lengths[below]
            chosen[n] = min(room // n, counts[n])
            room -= n * chosen[n]
        left = {n: counts[n] - chosen.get(n, 0) for n in lengths} if room else {}
        while room and (pair := _widened(lengths, left, smallest := min(chosen), room + smallest)):
            for n, change in ((smallest, -1), (pair[0], 1), (pair[1], 1)):
                chosen[n] = chosen.get(n, 0) + change
                left[n] -= change
            if not chosen[smallest]:
                del chosen[smallest]
            room += smallest - sum(pair)
        times = min(counts[n] // k for n, k in chosen.items())
        out.append((times, chosen))
        for n, k in chosen.items():
            counts[n] -= times * k
            if not counts[n]:
                del lengths[bisect_left(lengths, n)], counts[n]
    return out


def _slots(found: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Runs of ranks by (length, first rank): pieces of a length fill the patterns in order."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, chosen in found:
        offset = 0
        for n in sorted(chosen, reverse=True):
            rank = used.get(n, 0)
            rows.append((n, rank, sequence, chosen[n], offset))
            used[n] = rank + times * chosen[n]
            offset += n * chosen[n]
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def _ranked(rows: DataFrame, groups: int) -> DataFrame:
    """``rank`` of every piece among those of its length, from 0 without gaps."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "salt", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("rank", F.row_number().over(inside) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .drop("salt", "before")
    )


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``with_ids`` adds the ids (little-endian, four bytes each)."""
    rows = landed(pieces(docs, doc_id, text, path, with_ids))
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # CAPACITY rows at most
    found = patterns(histogram)
    shared = docs.sparkSession.sparkContext.broadcast(_slots(found))
    names = rows.columns + ["sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        starts = np.unique(slots["length"], return_index=True) if len(slots) else None
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy().astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy().astype(np.int64)
            run = np.empty(len(length), np.int64)
            for n in np.unique(length):
                low = int(starts[1][np.searchsorted(starts[0], n)])
                high = int(np.searchsorted(slots["length"], n, "right"))
                own = length == n
                run[own] = low + np.searchsorted(slots["rank"][low:high], rank[own], "right") - 1
            step = rank - slots["rank"][run]
            each = slots["each"][run]
            sequence = slots["sequence"][run] + step // each
            offset = slots["offset"][run] + step % each * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names)

    groups = 1 + sum(histogram.values()) // RANKED_TOGETHER * 2 + 15
    ranked = _ranked(rows, groups).select(*rows.columns, F.col("rank").cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
