"""A bitmap of keys, to leave most rows of a large table out before they are shuffled for a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 1 MB at any input size. False hits cost work only.
FILTER_BITS = 1 << 23
#: The largest bitmap sized by its keys (32 MB).
MOST_BITS = 1 << 28


def key_filter(keys: DataFrame, key: str = "key", size: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``size`` bits with the bit of every key set; its size does not depend on the input."""
    bit = F.pmod(F.col(key), F.lit(size)) + 1  # Spark's buckets count from one
    rows = (
        keys.select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    out = np.zeros(size // 8, np.uint8)
    for row in rows:
        part = np.frombuffer(row["bits"], np.uint8)
        start = (row["bucket"] - 1) * len(part)
        out[start : start + len(part)] = part
    return out


def sized_filter(keys: DataFrame, key: str = "key") -> np.ndarray:
    """A bitmap of the keys, of about 16 bits per key up to MOST_BITS."""
    return key_filter(keys, key, min(max(FILTER_BITS, 1 << (16 * keys.count()).bit_length()), MOST_BITS))


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    place = keys.astype(np.int64) % (8 * len(bits))
    return (bits[place >> 3] >> (place & 7) & 1).astype(bool)
