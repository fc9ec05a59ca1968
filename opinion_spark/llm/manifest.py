"""Merkle dataset manifest: a content-addressed tree over all rows, and a proof for every row.

Every row is a leaf, the SHA-256 of its fields. Per group (language) the leaves in the order of their ids are hashed in
pairs, level by level, a last single node alone, down to one subroot; the subroots in the order of their groups are
hashed likewise to the root. The tree is kept as records ``digest -> children``: one record spans ``FAN_BITS`` binary levels,
so it has at most 256 children, and its inner nodes follow from them.

Proofs are found by descent. Requests start with the root's digest; each step joins them to the records by digest and
opens the children by the next digit (eight bits) of the rank, appending the children that were not selected to the path. Requests
with equal digits so far are one request, so the root is asked for once and a step has as many rows as there
are nodes of its level. At the last step up to 256 leaves meet one record; their path, collected from the root down, is
reversed into the proof.

Ranks need no single task: rows are sorted by ranges, numbered inside each range, and the driver adds one number per
range. Groups of any size are spread over the ranges, and no group is gathered beyond 256 nodes.

NULL fields have a mark of their own, distinct from every text. The NULL group is the first group, NULL ids come first in
their group. Rows of equal ids are ordered by their leaf; equal rows have equal leaves, and each its own place and proof. An empty
table has no rows and no root. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinion_spark.llm.store import landed

#: Binary levels of one record.
FAN_BITS = 8
#: A step of a path: 0 no sibling, 1 sibling to the left, 2 to the right; then its digest.
_STEP = 33
_ALONE, _LEFT, _RIGHT = 0, 1, 2


class Manifest(NamedTuple):
    """``requests(group, block, entries)``: leaves by 256; ``levels`` and ``top``: records of the groups' trees and of the tree over
    them, lowest first; ``subroots(group, index, digest)``; ``root`` (None for an empty table)."""

    requests: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: bytes | None


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields: ``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""

    def written(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*map(written, fields)), 256))


def _joined(*digests: bytes) -> bytes:
    return hashlib.sha256(hexlify(b"".join(digests))).digest()


def _tree(children: bytes, height: int) -> list[list[bytes]]:
    """The binary levels over a record's children, lowest first; the last one has one node."""
    levels = [[children[k : k + 32] for k in range(0, len(children), 32)]]
    for _ in range(height):
        below = levels[-1]
        levels.append([_joined(*below[k : k + 2]) for k in range(0, len(below), 2)])
    return levels


def _siblings(levels: list[list[bytes]], digit: int) -> bytes:
    """Steps to a child, from the record's node down."""
    out = []
    for j in range(len(levels) - 2, -1, -1):
        place = digit >> j
        other = place ^ 1
        if other < len(levels[j]):
            out.append(bytes([_LEFT if other < place else _RIGHT]) + levels[j][other])
        else:
            out.append(bytes(_STEP))
    return b"".join(out)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (group first) with their range, their place within range and group, and whether the group is the range's first."""
    part = TaskContext.get().partitionId()
    began, current, place, first = False, None, 0, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        code = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        head = batch.column(0)[0].as_py()
        same = began and head == current
        first = first and (same or not began)
        run = np.zeros(n, np.int64)
        run[start[1:]] = 1
        run = np.cumsum(run)
        position = np.arange(n) - start[run] + np.where(run == 0, place if same else 0, 0)
        leading = (run == 0) & first
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(position), pa.array(leading)],
            [*batch.schema.names, "part", "position", "leading"],
        )
        began, current, place = True, batch.column(0)[n - 1].as_py(), int(position[-1]) + 1
        first = first and len(start) == 1


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (first column: group) with ``rank`` by the other columns within the group, from 0 without gaps."""
    names = rows.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    in_order = rows.repartitionByRange(*names).sortWithinPartitions(*names)
    numbered = landed(in_order.mapInArrow(_numbered, f"{kinds}, part int, position long, leading boolean"))
    runs = numbered.groupBy("part", names[0], "leading").agg(F.count("*").alias("rows"))
    by_part = Window.partitionBy("part").orderBy(names[0])
    edges = runs.withColumn("last", F.lead("rows").over(by_part).isNull()).where("leading or last")
    offsets, group, before = [], None, 0
    for part, own, leading, size, last in sorted(edges.select("part", names[0], "leading", "rows", "last").collect(), key=lambda r: (r[0], not r[2])):
        if leading:  # two rows per range at most reach the driver
            before = before if own == group else 0
            offsets.append((part, before))
            before += size
        elif last:
            before = size
        group = own
    shift = rows.sparkSession.createDataFrame(offsets, "part int, shift long")
    rank = F.col("position") + F.when(F.col("leading"), F.col("shift")).otherwise(0)
    return numbered.join(F.broadcast(shift), "part").select(*names, rank.alias("rank"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, index, children) to (group, index, digest, height, children)."""
    for batch in batches:
        digests, heights = [], []
        for index, children in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n = len(children) // 32
            # The first of several blocks is full, so a first block that is not full is the only one and ends at its top.
            height = FAN_BITS if index else (n - 1).bit_length()
            digests.append(_tree(children, height)[-1][0])
            heights.append(height)
        columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(heights, pa.int32()), batch.column(2)]
        yield pa.RecordBatch.from_arrays(columns, ["group", "index", "digest", "height", "children"])


def _recorded(blocks: DataFrame) -> DataFrame:
    return landed(blocks.mapInArrow(_records, "group string, index long, digest binary, height int, children binary"))


def _upwards(lowest: DataFrame) -> list[DataFrame]:
    """Records of all levels over those of the lowest, until every group has one node."""
    levels = [lowest]
    while levels[-1].agg(F.max("index")).first()[0]:
        digit = F.col("index").bitwiseAND((1 << FAN_BITS) - 1)
        nodes = levels[-1].groupBy("group", F.shiftright("index", FAN_BITS).alias("block"))
        inside = F.sort_array(F.collect_list(F.struct(digit.alias("digit"), "digest")))
        blocks = nodes.agg(inside.alias("nodes")).select("group", F.col("block").alias("index"), _bytes_of(F.col("nodes.digest")))
        levels.append(_recorded(blocks))
    return levels


def _bytes_of(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, b: F.concat(a, b)).alias("children")


def build(docs: DataFrame, leaf: Column, altered: Column | None = None, group: str = "lang", doc_id: str = "doc_id") -> Manifest:
    """The manifest of all rows. ``leaf``: a 32-byte digest; ``altered``: another one for rows that are checked as if they had been
    changed (NULL: unchanged)."""
    changed = F.lit(None).cast("binary") if altered is None else altered
    leaves = landed(
        docs.select(
            F.col(group).cast("string").alias("group"),
            F.col(doc_id).cast("long").alias("id"),
            leaf.alias("leaf"),
            F.monotonically_increasing_id().alias("copy"),
            changed.alias("altered"),
        )
    )
    entry = F.struct(F.col("rank").bitwiseAND((1 << FAN_BITS) - 1).cast("int").alias("digit"), "id", "leaf", "altered")
    blocks = _ranked(leaves).groupBy("group", F.shiftright("rank", FAN_BITS).alias("block"))
    requests = landed(blocks.agg(F.sort_array(F.collect_list(entry)).alias("entries")))
    levels = _upwards(_recorded(requests.select("group", F.col("block").alias("index"), _bytes_of(F.col("entries.leaf")))))
    ends = levels[-1].select(F.lit(None).cast("string").alias("group"), F.col("group").alias("name"), "digest")
    subroots = landed(_ranked(ends))
    digit = F.col("rank").bitwiseAND((1 << FAN_BITS) - 1)
    inside = F.sort_array(F.collect_list(F.struct(digit.alias("digit"), "digest")))
    lowest = subroots.groupBy("group", F.shiftright("rank", FAN_BITS).alias("index")).agg(inside.alias("nodes"))
    top = _upwards(_recorded(lowest.select("group", "index", _bytes_of(F.col("nodes.digest")))))
    root = top[-1].select("digest").first()
    named = subroots.select(F.col("name").alias("group"), F.col("rank").alias("index"), "digest")
    return Manifest(requests, levels, top, named, bytes(root[0]) if root else None)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, index, subroot, path, height, children) to one row per child."""
    names = ["group", "index", "subroot", "digest", "path"]
    for batch in batches:
        for row in batch.to_pylist():
            levels = _tree(row["children"], row["height"])
            children = levels[0]
            n = len(children)
            first = row["index"] << FAN_BITS
            columns = [
                pa.array([row["group"]] * n, pa.string()),
                pa.array(range(first, first + n), pa.int64()),
                pa.array([row["subroot"]] * n, pa.binary()),
                pa.array(children, pa.binary()),
                pa.array([row["path"] + _siblings(levels, digit) for digit in range(n)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


def _descended(frontier: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Requests of the levels' top nodes, followed down through the records of all these levels."""
    for level in reversed(levels):
        records = level.select("digest", "height", "children").dropDuplicates(["digest"])
        asked = frontier.join(records, "digest").select("group", "index", "subroot", "path", "height", "children")
        frontier = landed(asked.mapInArrow(_opened, "group string, index long, subroot binary, digest binary, path binary"))
    return frontier


def _folded(leaf: bytes, path: bytes) -> bytes:
    node = leaf
    for k in range(0, len(path), _STEP):
        side, other = path[k], path[k + 1 : k + _STEP]
        node = _joined(node) if side == _ALONE else _joined(other, node) if side == _LEFT else _joined(node, other)
    return node


def proofs(manifest: Manifest, with_proof: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the siblings from the leaf up), ``folded_root`` (from the
    altered leaf where there is one) and ``verified``; ``with_proof`` adds the siblings themselves, each with its side."""
    root = manifest.root
    spark = manifest.requests.sparkSession
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * with_proof
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", proof array<string>" * with_proof
    if root is None:
        return spark.createDataFrame([], schema)
    start = spark.createDataFrame([(None, 0, None, root, b"")], "group string, index long, subroot binary, digest binary, path binary")
    over_groups = _descended(start, manifest.top).select("index", "digest", "path")
    frontier = over_groups.join(manifest.subroots.select("group", "index"), "index").select(
        "group", F.lit(0).cast("long").alias("index"), F.col("digest").alias("subroot"), "digest", "path"
    )
    nodes = _descended(landed(frontier), manifest.levels[1:])
    lowest = manifest.levels[0].select("digest", "height", "children").dropDuplicates(["digest"])
    own = manifest.requests.select(F.col("group").alias("g"), "block", "entries")
    asked = nodes.join(own, (nodes["group"].eqNullSafe(own["g"])) & (nodes["index"] == own["block"])).join(lowest, "digest")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for subroot, path, height, children, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels = _tree(children, height)
                rows = []
                for entry in entries:
                    down = path + _siblings(levels, entry["digit"])
                    up = b"".join(down[k : k + _STEP] for k in range(len(down) - _STEP, -1, -_STEP))
                    kept = [(up[k], up[k + 1 : k + _STEP]) for k in range(0, len(up), _STEP) if up[k]]
                    again = _folded(entry["altered"] or entry["leaf"], up)
                    digests = (entry["leaf"].hex(), subroot.hex(), root.hex(), _joined(*(d for _, d in kept)).hex(), again.hex())
                    proof = ([f"{' LR'[side]}:{d.hex()}" for side, d in kept],) if with_proof else ()
                    rows.append((entry["id"], *digests, again == root, *proof))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), *[pa.list_(pa.string())] * with_proof]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return asked.select("subroot", "path", "height", "children", "entries").mapInArrow(answered, schema)


def document_manifest(docs: DataFrame) -> Manifest:
    """The manifest of a table of documents; where 7 divides the CRC-32 of the id, rows are checked with one more in ``n_chars``."""

    def digest(n_chars: Column) -> Column:
        return leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])

    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.col("n_chars").cast("long")
    return build(docs, digest(n_chars), F.when(chosen, digest(n_chars + 1)))
