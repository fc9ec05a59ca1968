"""Compare a Spark result with DuckDB's result of the equivalent SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def difference(frame, con, sql: str) -> str | None:
    """None when column names and the multiset of rows agree, else a description."""
    table = con.execute(sql)
    names = [d[0] for d in table.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    order = sorted(names)
    place = [names.index(c) for c in order]
    want = Counter(tuple((type(plain(r[i])).__name__, plain(r[i])) for i in place) for r in table.fetchall())
    got = Counter(
        tuple((type(plain(v)).__name__, plain(v)) for v in r)
        for r in frame.select(*[f"`{c}`" for c in order]).collect()
    )
    if want == got:
        return None
    missing, extra = list((want - got).items())[:3], list((got - want).items())[:3]
    return f"rows {sum(got.values())} vs {sum(want.values())}; missing {missing}; extra {extra}"[:1500]


def physical(frame) -> str:
    """The physical plan as text."""
    return frame._jdf.queryExecution().executedPlan().toString()
