"""Words and word windows of text columns, as numpy arrays inside Arrow tasks.

A word is a run of bytes other than space and 0x09-0x0D. Words are hashed straight from the column's bytes, without
a Python object per word: a byte stands for a random 64-bit number, and a word's hash is the sum of its bytes'
numbers times powers of an odd constant, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1024

_U64 = (1 << 64) - 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_EXACT[_BLANK] = 0
_FOLDED = _EXACT.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _EXACT[ord("a") : ord("z") + 1]
_powers = np.ones(1, np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser (SplitMix64), so that every output bit depends on every input bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(classes: dict[int, int]) -> np.ndarray:
    """Numbers for bytes by which bytes of one class look alike; others stay themselves, blanks stay blanks."""
    out = _EXACT.copy()
    for byte, kind in classes.items():
        out[byte] = mixed(np.array([kind], np.uint64))[0] | np.uint64(1)
    return out


class WordTable(NamedTuple):
    """The words of consecutive texts: text ``i`` has the words ``first[i]:first[i + 1]``; word ``w`` is
    ``data[starts[w]:ends[w]]``; text ``i`` begins at byte ``offsets[i]``."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 256), _STEP, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offset of every text in them; NULL is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    text = np.frombuffer(data, np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
    return text, offsets.astype(np.int64) - low


def word_table(column: pa.Array, fold: bool, table: np.ndarray | None = None) -> WordTable:
    """All words of a text column; ``fold`` treats A-Z as a-z, ``table`` gives other numbers for bytes, 0 for those between words."""
    numbers = table if table is not None else _FOLDED if fold else _EXACT
    data, offsets = raw(column)
    n = len(data)
    inside = numbers[data] != 0
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        none = np.empty(0, np.int64)
        return WordTable(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, data, offsets)
    begin = int(starts[0])
    span = np.diff(np.append(starts, n))
    place = np.arange(n - begin) - np.repeat(starts - begin, span)
    length = ends - starts
    place = np.minimum(place, int(length.max()) - 1)  # blanks after a word count nothing
    values = numbers[data[begin:]] * _powers_to(int(length.max()))[place]
    sums = np.add.reduceat(values, starts - begin)
    hashes = mixed(sums + length.astype(np.uint64))
    return WordTable(hashes, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` word hashes; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, width * 0x9E3779B97F4A7C15 & _U64, np.uint64)
    factor = 1
    for k in range(width):
        factor = factor * 0xD6E8FEB86659FD93 & _U64
        total += hashes[k : k + n] * np.uint64(factor)
    return mixed(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_lists(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For every text the hashes of its ``width``-word runs in order, A-Z as a-z; with fewer words one hash of
    the whole sequence; none without words."""
    table = word_table(column, fold=True)
    windows = window_hashes(table.hashes, width)
    for low, high in zip(table.first[:-1].tolist(), table.first[1:].tolist(), strict=True):
        if high - low >= width:
            yield windows[low : high - width + 1]
        else:
            yield window_hashes(table.hashes[low:high], max(high - low, 1))


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct values of ``shingle_lists``."""
    return map(distinct, shingle_lists(column, width))


def set_hash(values: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted array."""
    value = xxhash.xxh3_64_intdigest(values.data)
    return value - (1 << 64) if value >> 63 else value


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``SLICE_BYTES`` of the text column, a single longer row apart."""
    offsets = raw(batch.column(text))[1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES))
        stop = min(max(stop, start + 1), start + SLICE_ROWS, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; NULL is the empty text."""
    data, offsets = raw(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def unsigned(values: np.ndarray) -> np.ndarray:
    return values.view(np.uint64)
