"""Partial sums of tasks, added up before they reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Columns of partial sums: the part of the model, and doubles as bytes.
PART_SUMS = "part int, sums binary"
#: Tasks that add.
ADDERS = 16


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(value.as_buffer())
            found[part] = found[part] + own if part in found else own
    columns = [pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["part", "sums"])


def total_per_part(sums: DataFrame, adders: int = ADDERS) -> DataFrame:
    """One row per part, so that what is collected does not grow with the number of tasks."""
    return sums.repartition(adders, "part").mapInArrow(_added, PART_SUMS)
