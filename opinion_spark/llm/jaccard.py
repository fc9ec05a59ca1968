"""N-gram Jaccard join: documents linked by the overlap of their word shingles.

The document by shingle incidence matrix A is multiplied with its transpose block by block. A block is one
shingle's column; the product accumulates, per pair of rows, the number of shared columns. Three facts keep
the product sparse, and none of them loses a link:

* Documents with equal shingle sets are one row of A (a class), identified by a hash of the set.
* Bounds from sizes. With similarity t, ``min(n) >= t * max(n)``, and the overlap must reach
  ``t / (1 + t) * (n1 + n2)``. If columns are ordered, linked rows share one of their first
  ``n - ceil(t n) + 1`` columns, so only those enter the product, and a pair whose accumulated overlap plus all
  that its unmultiplied columns could add stays below the bound is discarded. What is left is verified exactly.
* Columns are ordered with the most frequent ones last, so passages that many documents share are rarely among
  the first. The order changes the work only, never the result.

Columns with more than ``SHORT`` rows (large groups of near copies) are not multiplied out at first: each row of them is
tested against one leading row, the links found are contracted to components, and then only rows of different components
are multiplied, under the same bounds.

NULL and blank texts have no shingles and are linked with nothing. Repeated rows are equal rows of one class.
A document below five words has its whole word sequence as its only shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.llm import words as W
from opinion_spark.llm.components import components
from opinion_spark.llm.filters import passes, sized_filter
from opinion_spark.llm.store import landed, renamed_apart, row_key

#: Similarity in hundredths.
PERCENT = 75
#: A column of at most so many rows is multiplied out.
SHORT = 32
#: Shingles are counted in runs of about so many; those seen at least FREQUENT times in a run are reported.
RUN_SHINGLES = 1_000_000
FREQUENT = 3
#: So many of the most frequent shingles are sent to all tasks (16 bytes each). It bounds memory, not results.
ORDERED = 65_536
#: Least bits per shingle of a row's signature, by which most pairs are found too different before whole sets are moved.
SIGNATURE_BITS = 4
#: So many classes a task remembers as already given.
REMEMBERED = 500_000
#: A shingle reported so often in all is a long column from the start; its rows need not meet in one task.
LONG = 1_000


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) to one row per document, and rows of shingles frequent within a run."""
    run: list[np.ndarray] = []
    held, seen = 0, set()

    def frequent() -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(run), return_counts=True)
        keep = count >= FREQUENT
        n = int(keep.sum())
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array(W.signed(value[keep])), pa.array(count[keep].astype(np.int64))],
            ["id", "key", "class", "n", "shingle", "count"],
        )

    for batch in batches:
        for part in W.slices(batch, 2):
            classes, sizes = [], []
            for found in W.shingle_sets(part.column(2)):
                sizes.append(len(found))
                classes.append(W.set_hash(found) if len(found) else None)
                if len(found) and classes[-1] not in seen:
                    seen.add(classes[-1])
                    run.append(found)
                    held += len(found)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(classes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.int64()),
                ],
                ["id", "key", "class", "n", "shingle", "count"],
            )
            if held >= RUN_SHINGLES:
                yield frequent()
                run, held, seen = [], 0, set()
    if run:
        yield frequent()


def _first_columns(found: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first columns of a row in the common order, and which of them are long from the start."""
    length = len(found) - (PERCENT * len(found) + 99) // 100 + 1
    counts = np.zeros(len(found), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        counts = np.where(hot[at] == found, rank[at], 0)
    first = np.lexsort((found, counts))[:length]
    return found[first], counts[first] >= LONG


def _postings(hot_shared, rank_shared):
    """text to (shingle, class, place): place holds the set's size and the column's position, and is negative for
    a long column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank, seen = hot_shared.value, rank_shared.value, set()
        for batch in batches:
            for part in W.slices(batch, 0):
                shingle, owner, place = [], [], []
                for found in W.shingle_sets(part.column(0)):
                    if not len(found) or (name := W.set_hash(found)) in seen:
                        continue
                    seen.add(name)
                    first, frequent = _first_columns(found, hot, rank)
                    at = (np.int64(len(found)) << np.int64(32)) + np.arange(len(first), dtype=np.int64)
                    shingle.append(W.signed(first))
                    owner.append(np.full(len(first), name, np.int64))
                    place.append(np.where(frequent, -at, at))
                if len(seen) > REMEMBERED:
                    seen.clear()
                if shingle:
                    columns = [pa.array(np.concatenate(x)) for x in (shingle, owner, place)]
                    yield pa.RecordBatch.from_arrays(columns, ["shingle", "class", "place"])

    return run


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by (shingle, class) to pairs of rows that share a short column (``long`` false: a, b, sizes, whether
    the column stands early enough), and the rows of long columns (``long`` true: shingle, class, size, position)."""
    names = ["long", "a", "b", "na", "nb", "early"]

    def made(is_long: bool, a, b, na, nb, early) -> pa.RecordBatch:
        flags = np.full(len(a), is_long)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (flags, a, b, na, nb, early)], names)

    def rows_of_long(s, c, p):
        at = np.abs(p)
        return made(True, s, c, at >> 32, at & 0xFFFFFFFF, np.ones(len(s), bool))

    def block(s, c, p):
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        length = np.diff(np.concatenate([start, [len(s)]]))
        of = np.repeat(length, length)
        if (many := of > SHORT).any():
            yield rows_of_long(s[many], c[many], p[many])
        keep = (of > 1) & ~many
        s, c, n, at = s[keep], c[keep], p[keep] >> 32, p[keep] & 0xFFFFFFFF
        for step in range(1, SHORT):
            if len(s) <= step:
                break
            same = s[step:] == s[:-step]
            if not same.any():
                break
            a, b, na, nb = c[:-step][same], c[step:][same], n[:-step][same], n[step:][same]
            least = -(-PERCENT * (na + nb) // (100 + PERCENT))
            early = (at[:-step][same] + least <= na) & (at[step:][same] + least <= nb)
            fits = least <= np.minimum(na, nb)
            if fits.any():
                yield made(False, a[fits], b[fits], na[fits], nb[fits], early[fits])

    rest = [np.empty(0, np.int64)] * 3
    open_long = None
    for batch in batches:
        s, c, p = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        if (hot := p < 0).any():
            yield rows_of_long(s[hot], c[hot], p[hot])
            s, c, p = s[~hot], c[~hot], p[~hot]
        s, c, p = (np.concatenate(x) for x in zip(rest, (s, c, p), strict=True))
        if len(s) and open_long is not None:
            more = s == open_long
            if more.any():
                yield rows_of_long(s[more], c[more], p[more])
                s, c, p = s[~more], c[~more], p[~more]
        if len(s):
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
            s, c, p = s[new], c[new], p[new]
            last = np.searchsorted(s, s[-1])
            if last:
                yield from block(s[:last], c[:last], p[:last])
            rest = [s[last:], c[last:], p[last:]]
            if len(rest[0]) > SHORT:
                open_long = s[-1]
                yield rows_of_long(*rest)
                rest = [np.empty(0, np.int64)] * 3
        else:
            rest = [s, c, p]
    if len(rest[0]):
        yield from block(*rest)


def _signature(found: np.ndarray) -> bytes:
    """A bit per shingle, at a place given by its hash. The number of bits is a power of two that follows the set's size, so
    long sets do not fill theirs."""
    size = max(64, 1 << (SIGNATURE_BITS * len(found) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(found % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _sets(filter_shared):
    """(key, text) to (class, n, signature, shingles) where the filter has the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = filter_shared.value, set()
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, batch.column(0).to_numpy(zero_copy_only=False))))
            for part in W.slices(batch, 1):
                found = {}
                for x in W.shingle_sets(part.column(1)):
                    if len(x) and (name := W.set_hash(x)) not in seen:
                        seen.add(name)
                        found[name] = x
                if len(seen) > REMEMBERED:
                    seen.clear()
                columns = [
                    pa.array(found, pa.int64()),
                    pa.array([len(x) for x in found.values()], pa.int64()),
                    pa.array([_signature(x) for x in found.values()], pa.binary()),
                    pa.array([x.tobytes() for x in found.values()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["class", "n", "signature", "shingles"])

    return run


def _folded(signatures: pa.Array, width: int) -> np.ndarray:
    """Signatures of one length, a row each, as they would be in ``width`` bytes."""
    table = np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(len(signatures), -1)
    while table.shape[1] > width:
        half = table.shape[1] // 2
        table = table[:, :half] | table[:, half:]
    return table


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sizes, signatures) to the pairs that can be linked: a shingle of a whose bit b lacks is not in b."""
    for batch in batches:
        na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        widths = np.stack([pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False) for k in (4, 5)], 1)
        kinds, kind = np.unique(widths, axis=0, return_inverse=True)
        keep = np.zeros(batch.num_rows, bool)
        for k, both in enumerate(kinds):
            rows = np.flatnonzero(kind.ravel() == k)
            left, right = (_folded(batch.column(c).take(pa.array(rows)), int(both.min())) for c in (4, 5))
            only_left = np.bitwise_count(left & ~right).sum(1, dtype=np.int64)
            only_right = np.bitwise_count(right & ~left).sum(1, dtype=np.int64)
            most = np.minimum(na[rows] - only_left, nb[rows] - only_right)
            keep[rows] = 100 * most >= PERCENT * (na[rows] + nb[rows] - most)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _of_classes(filter_shared):
    """(class, shingles) where the filter has the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_shared.value
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, batch.column(0).to_numpy(zero_copy_only=False))))

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity: signatures first, then the sets of the classes that these leave. Only
    those sets are shuffled."""

    def of(table: DataFrame, side: str) -> DataFrame:
        one = table.dropDuplicates(["class"])
        return one.select(F.col("class").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in table.columns[1:]])

    marks = sets.select("class", "n", "signature")
    marked = pairs.select("a", "b").join(of(marks, "a"), "a").join(of(marks, "b"), "b")
    left = landed(marked.select("a", "b", "n_a", "n_b", "signature_a", "signature_b").mapInArrow(_possible, "a long, b long"))
    classes = left.select(F.col("a").alias("class")).unionByName(left.select(F.col("b").alias("class"))).distinct()
    shared = sets.sparkSession.sparkContext.broadcast(sized_filter(classes, "class"))
    wanted = landed(sets.select("class", "shingles").mapInArrow(_of_classes(shared), "class long, shingles binary"))
    whole = left.join(of(wanted, "a"), "a").join(of(wanted, "b"), "b")
    return whole.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_verified, "a long, b long")


def _least_overlap(a: Column, b: Column) -> Column:
    """Least overlap of linked sets of these sizes."""
    return F.ceil(PERCENT * (a + b) / F.lit(100 + PERCENT))


def _untouched(n: Column) -> Column:
    """Columns of a row that do not enter the product."""
    return F.ceil(PERCENT * n / F.lit(100)) - 1


def _early(n: Column, position: Column, other_n: Column, other_position: Column) -> Column:
    """Whether a common column stands early enough in both rows for the overlap that the pair needs."""
    least = _least_overlap(n, other_n)
    return (position + least <= n) & (other_position + least <= other_n)


def _crossed(rows: DataFrame, others: DataFrame, once: bool = False) -> DataFrame:
    """Pairs of rows of one column and different components that can be linked; ``once`` if both sides hold both rows."""
    other = others.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("class", "n", "position", "component")])
    apart = (
        (rows["shingle"] == other["shingle"])
        & (F.col("component") != F.col("other_component"))
        & _early(F.col("n"), F.col("position"), F.col("other_n"), F.col("other_position"))
    )
    if once:
        apart &= F.col("class") < F.col("other_class")
    return (
        rows.join(other, apart)
        .select(F.least("class", "other_class").alias("a"), F.greatest("class", "other_class").alias("b"))
        .distinct()
    )


def _joined_long(rows: DataFrame, edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges, with as many more as the long columns need for the right components."""
    if rows.isEmpty():
        return edges
    for stars in (True, False):
        roots = components(edges)
        placed = rows.join(roots, rows["class"] == roots["node"], "left").select(
            *[rows[c] for c in ("shingle", "class", "n", "position")], F.coalesce("root", rows["class"]).alias("component")
        )
        open_lists = (
            placed.groupBy("shingle")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .where(F.col("low") != F.col("high"))
            .select("shingle")
        )
        placed = landed(placed.join(open_lists, "shingle", "left_semi"))
        if placed.isEmpty():
            break
        if stars:
            one = placed.groupBy("class").agg(F.min_by(F.struct(*placed.columns), F.struct("position", "shingle")).alias("row")).select("row.*")
            first = placed.groupBy("shingle").agg(F.min(F.struct("position", "class", "n", "component")).alias("first"))
            pairs = _crossed(one, first.select("shingle", "first.*"))
        else:
            above = placed.select(*[F.col(c).alias(c) for c in placed.columns])
            pairs = _crossed(placed, above, once=True)
        edges = landed(edges.unionByName(_linked(pairs, sets)))
    return edges


def _analysed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Members (id, key, class, n), and the root of every class that has a link."""
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text))
    profile = landed(
        source.mapInArrow(_profile, "id long, key long, class long, n long, shingle long, count long")
    )
    members = profile.where(F.col("n").isNotNull()).select("id", "key", "class", "n")
    frequent = (
        profile.where(F.col("shingle").isNotNull())
        .groupBy("shingle")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "shingle")
        .limit(ORDERED)
        .toArrow()
    )
    hot = W.unsigned(frequent["shingle"].to_numpy().astype(np.int64))
    by_value = np.argsort(hot)
    hot_shared, rank_shared = sc.broadcast(hot[by_value]), sc.broadcast(frequent["count"].to_numpy().astype(np.int64)[by_value])

    only_text = docs.select(F.col(text))
    spread = F.when(F.col("place") < 0, F.pmod(F.col("class"), F.lit(256))).otherwise(0)
    product = landed(
        only_text.mapInArrow(_postings(hot_shared, rank_shared), "shingle long, class long, place long")
        .repartition(F.col("shingle"), spread)
        .sortWithinPartitions("shingle", "class")
        .mapInArrow(_product, "long boolean, a long, b long, na long, nb long, early boolean")
    )
    in_lists = product.where("long").select(
        F.col("a").alias("shingle"), F.col("b").alias("class"), F.col("na").alias("n"), F.col("nb").alias("position")
    )
    sizes = in_lists.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    rows = landed(
        in_lists.dropDuplicates(["shingle", "class"]).join(sizes.where(F.col("low") != F.col("high")).select("shingle"), "shingle", "left_semi")
    )

    # Long columns are not in the accumulated overlap: both rows may share as many as the one with fewer has.
    hidden = landed(rows.groupBy("class").agg(F.count("*").alias("hidden")))
    counted = (
        product.where(~F.col("long"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("early").alias("early"))
        .where("early")
    )
    for side in ("a", "b"):
        counted = counted.join(hidden.select(F.col("class").alias(side), F.col("hidden").alias(f"hidden_{side}")), side, "left")
    most = (
        F.col("shared")
        + F.least(F.coalesce("hidden_a", F.lit(0)), F.coalesce("hidden_b", F.lit(0)))
        + F.greatest(_untouched(F.col("na")), _untouched(F.col("nb")))
    )
    pairs = landed(counted.where(most >= _least_overlap(F.col("na"), F.col("nb"))).select("a", "b"))

    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).unionByName(rows.select("class"))
    # One row stands for its class; equal rows may come twice, which repeats pairs and changes nothing.
    keys = members.join(wanted.distinct(), "class", "left_semi").groupBy("class").agg(F.min("key").alias("key"))
    filter_shared = sc.broadcast(sized_filter(keys))
    keyed = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text))
    sets = landed(keyed.mapInArrow(_sets(filter_shared), "class long, n long, signature binary, shingles binary"))
    edges = _joined_long(rows, landed(_linked(pairs, sets)), sets)
    return members, components(edges)


def _grouped(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with ``root``: one value per component, NULL for documents without shingles."""
    return members.join(roots, members["class"] == roots["node"], "left").select(
        *[members[c] for c in members.columns], F.coalesce("root", members["class"]).alias("root")
    )


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (least id reachable by links)."""
    grouped = _grouped(*_analysed(docs, doc_id, text))
    least = grouped.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("component_id"))
    return grouped.join(least, "root", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the least id (then least row key). Documents
    without shingles all stay; all columns are kept."""
    grouped = _grouped(*_analysed(docs, doc_id, text)).where(F.col("root").isNotNull())
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"), F.count("*").alias("size"))
    crowded = landed(first.where(F.col("size") > 1).select("root", F.col("first.key").alias("kept")))
    held = landed(
        grouped.join(crowded, "root").groupBy("key").agg(F.count("*").alias("copies"), F.max(F.col("key") == F.col("kept")).alias("is_kept"))
    )
    key, name = row_key(F.col(doc_id), F.col(text)), renamed_apart(docs, "other_key")["other_key"]
    gone = held.where(~F.col("is_kept") | (F.col("copies") > 1)).select(F.col("key").alias(name))
    out = docs.join(gone, key == F.col(name), "left_anti")
    repeated = held.where(F.col("is_kept") & (F.col("copies") > 1)).select(F.col("key").alias(name))
    if repeated.isEmpty():
        return out
    one = docs.join(repeated, key == F.col(name)).dropDuplicates([name]).drop(name)
    return out.unionByName(one)
