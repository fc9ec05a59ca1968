"""Value encodings for predictor columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names, device names and their codes.
CLASS_CODES = {"positive": 1, "negative": -1, "netral": 0}
DEVICE_CODES = {"Twitter for iPhone": 0, "Twitter for Android": 1, "Twitter Web App": 2}
OTHER_DEVICE = 3


def code_of(value: Column, codes: Mapping[str, int], other: Column | int | None = None) -> Column:
    """Look a value up in a short mapping; ``other`` for anything else, NULL included."""
    branches = iter(codes.items())
    name, code = next(branches)
    chain = F.when(value == name, F.lit(code))
    for name, code in branches:
        chain = chain.when(value == name, F.lit(code))
    other = other if isinstance(other, Column) else F.lit(other)
    return chain.otherwise(other).cast("int")


def class_code(name: Column) -> Column:
    """positive, negative, netral -> 1, -1, 0; numbers given as text are kept."""
    return code_of(name, CLASS_CODES, name.cast("string").try_cast("int"))


def device_code(source: Column) -> Column:
    """The three named devices -> 0, 1, 2; every other value -> 3."""
    return code_of(source, DEVICE_CODES, OTHER_DEVICE)


def flag(value: Column) -> Column:
    """Boolean -> 1/0."""
    return value.cast("int")


def presence_flag(value: Column) -> Column:
    """1 where a value is present, 0 where it is missing."""
    return value.isNotNull().cast("int")


def nonempty_flag(value: Column) -> Column:
    """0 for the empty string, 1 otherwise (a missing value counts as 1)."""
    return F.when(value == "", F.lit(0)).otherwise(F.lit(1))
