"""MinHash near-dedup by a chosen-path set similarity join.

Documents with equal shingle sets are one record. Independent trees sort the records: at a tree's root a record takes the branch
of its least shingle under the tree's own hash. A node of at most ``SMALL`` records is compared exhaustively; a larger one is
split again, each record following its least shingle under the node's own hash (of its ``LEAST_TOKENS`` least shingles), and in
``1 / similarity - 1`` of the nodes a second one, so that a linked pair meets in one branch of every level on average. A pair whose
similarity is t parts at the roots of all ``TREES`` trees with chance ``(1 - t) ** TREES``: 1.3e-10 at 0.85.

What enters verification. In a small node the pairs whose sizes and sketches allow a link, and the same within random parts of
a large node. Every record's best pair is verified first, on whole sets; then all other pairs whose records are still in
different components. Large nodes whose records are all in one component by then need no splitting, so a group of near copies
mostly ends early. There is no cap: nodes are split until they are small or closed.

No group meets in one task: node sizes are counted with map-side aggregates, only small nodes are gathered, and joins
on node or class are between landed tables, which adaptive execution splits where they are skewed.

Classes are told apart by 128 bits. NULL and blank texts have no shingles and are linked with nothing. A document below five words
has its whole word sequence as its only shingle. Repeated rows are equal rows of one class; NULL ids link but are
no component's id unless no other is there. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.llm import words as W
from opinion_spark.llm.components import components
from opinion_spark.llm.filters import key_filter, passes
from opinion_spark.llm.store import landed

#: Similarity in hundredths.
PERCENT = 85
TREES = 12
#: Nodes of at most so many records are compared exhaustively.
SMALL = 32
#: Larger nodes go down one level at first, then twice as many at once as before, up to so many.
DEEPEST = 8
#: A sketch: bins of one byte each (0 stands for an empty bin), then a bit per shingle at a place given by its hash.
BINS, BITS = 64, 512
WIDTH = BINS + BITS // 8
#: Bits of the sharper sketch that records of large nodes get, and how many of their least shingles stand for them below.
SHARP_BITS, LEAST_TOKENS = 4096, 256
#: A large node ends if at most FEW of its rows are outside its main component: these are compared with all others, by so many rows together.
FEW, TOGETHER = 512, 1024
#: The bits rule out only pairs that cannot be linked. By the bins, pairs are discarded so many standard deviations below what
#: linked pairs show, and only where so many bins count.
SIGMAS, LEAST_BINS = 6.0, 32
#: How many edges are worth a task of their own when components are found.
EDGES_PER_TASK = 50_000

_SEEDS = np.random.default_rng(12).integers(1, 1 << 64, TREES, dtype=np.uint64) | np.uint64(1)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(58)


def _least(found: list[np.ndarray]) -> np.ndarray:
    """For every set its least token under each tree's hash, as node keys."""
    whole = np.concatenate(found)
    starts = np.cumsum([0, *map(len, found[:-1])])
    out = np.empty((len(found), TREES), np.uint64)
    for k, seed in enumerate(_SEEDS):
        values = (whole ^ (whole >> np.uint64(31))) * seed
        values ^= values >> np.uint64(32)
        values *= np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = W.mixed(np.minimum.reduceat(values, starts) ^ seed)
    return out


def sketch(found: np.ndarray) -> bytes:
    """A byte of the least value of every bin of the hash range, and a bit per value."""
    at = np.searchsorted(found, _EDGES)
    full = np.append(at[1:], len(found)) > at
    least = found[np.minimum(at, len(found) - 1)]
    bits = np.zeros(BITS, bool)
    bits[(found % np.uint64(BITS)).astype(np.int64)] = True
    return np.where(full, 1 + (least >> np.uint64(10)) % np.uint64(255), 0).astype(np.uint8).tobytes() + np.packbits(bits).tobytes()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text key, text) to (id, text key, class, n, tokens, sketch); tokens and sketch once per class of a task's run."""
    names, seen = ["id", "key", "class", "n", "tokens", "sketch"], set()
    for batch in batches:
        for part in W.slices(batch, 2):
            sets = list(W.shingle_sets(part.column(2)))
            classes = [xxhash.xxh3_128_digest(s.data) if len(s) else None for s in sets]
            fresh = []
            for i, name in enumerate(classes):
                if name is not None and name not in seen:
                    seen.add(name)
                    fresh.append(i)
            tokens, marks = [None] * len(sets), [None] * len(sets)
            if fresh:
                for i, row in zip(fresh, _least([sets[i] for i in fresh]), strict=True):
                    tokens[i], marks[i] = row.tobytes(), sketch(sets[i])
            if len(seen) > 200_000:
                seen.clear()
            columns = [
                part.column(0),
                part.column(1),
                pa.array(classes, pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(tokens, pa.binary()),
                pa.array(marks, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of ``width`` bytes each as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, tokens) to (node, record), one row per tree."""
    for batch in batches:
        if batch.num_rows:
            nodes = _fixed(batch.column(1), 8 * TREES).view(np.int64)
            record = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel()), pa.array(record)], ["node", "record"])


def _branches(levels: int):
    """(node, record, root, tokens) to the record's nodes ``levels`` below."""

    def least(node: np.ndarray, row: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Every row's least token under its node's own hash."""
        size = np.diff(first)[row]
        starts = np.concatenate([[0], np.cumsum(size)])[:-1]
        place = np.arange(int(size.sum())) + np.repeat(first[row] - starts, size)
        return np.minimum.reduceat(W.mixed(tokens[place] ^ np.repeat(node, size)), starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                node, record, root = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                node, row = W.unsigned(node.astype(np.int64)), np.arange(part.num_rows)
                values = part.column(3).to_pylist()
                tokens = np.frombuffer(b"".join(values), np.uint32).astype(np.uint64)
                first = np.concatenate([[0], np.cumsum([len(v) // 4 for v in values])])
                for _ in range(levels):
                    children = []
                    for which in (1, 2):
                        draw = W.mixed(node ^ np.uint64(which * 0x632BE59BD9B4E019 % (1 << 64)))
                        # A second token is the node's choice, so that its records stay together.
                        rows = np.arange(len(node)) if which == 1 else np.flatnonzero((draw >> np.uint64(40)) / 2.0**24 < 100 / PERCENT - 1)
                        if len(rows):
                            children.append((W.mixed(least(draw[rows], row[rows], tokens, first) ^ draw[rows]), row[rows]))
                    node, row = (np.concatenate(x) for x in zip(*children, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(node)), pa.array(record[row]), pa.array(root[row])], ["node", "record", "root"])

    return run


def _fit(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two records can be linked by their sizes and bits: a shingle whose bit the other record lacks is not in it."""
    x, y = (np.ascontiguousarray(v).view(np.uint64) for v in (a, b))
    most = np.minimum(na - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), nb - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
    return 100 * most >= PERCENT * (na + nb - most)


def _may_link(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether two records can be linked by their sizes and sketches, and how well the sketches agree (in thousandths)."""
    if a.shape[1] * 8 == SHARP_BITS:
        return _fit(na, nb, a, b), np.zeros(len(na), np.int64)
    fits = _fit(na, nb, a[:, BINS:], b[:, BINS:])
    a, b = a[:, :BINS], b[:, :BINS]
    used = ((a | b) > 0).sum(1)
    agreed = ((a == b) & (a > 0)).sum(1)
    t = PERCENT / 100
    low = t * used - SIGMAS * np.sqrt(t * (1 - t) * used)
    return fits & ((used < LEAST_BINS) | (agreed >= low)), 1000 * agreed // np.maximum(used, 1)


def _pair_rows(x: np.ndarray, y: np.ndarray, agreed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(agreed)], ["a", "b", "agreed"])


def _by_node(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Rows sorted by node, sketch last, as arrays that hold whole nodes."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_columns - 1
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(last)] + [_fixed(batch.column(last), width)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield [x[:cut] for x in now]
        rest = [x[cut:] for x in now]
    if rest is not None:
        yield rest


def _compared(width: int):
    """Rows (node, record, root, n, sketch) sorted by node to the pairs (a, b, agreed) of one node that can be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, record, root, n, marks in _by_node(batches, width):
            for step in range(1, SMALL):
                same = node[step:] == node[:-step]
                if not same.any():
                    break
                at = np.flatnonzero(same & (root[step:] != root[:-step]))
                for some in np.array_split(at, 1 + len(at) // 20_000):
                    keep, agreed = _may_link(n[some], n[some + step], marks[some], marks[some + step])
                    if keep.any():
                        yield _pair_rows(record[some][keep], record[some + step][keep], agreed[keep])

    return run


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, main, record, root, n, sketch) sorted by node, the few that are not of the main component first: these with all
    rows of the node."""
    for node, main, record, root, n, marks in _by_node(batches, SHARP_BITS // 8):
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        ends = np.append(starts[1:], len(node))
        for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
            for x in range(low, low + int(np.count_nonzero(~main[low:high]))):
                some = x + 1 + np.flatnonzero(root[x + 1 : high] != root[x])
                if len(some):
                    keep, agreed = _may_link(np.full(len(some), n[x]), n[some], np.broadcast_to(marks[x], marks[some].shape), marks[some])
                    if keep.any():
                        yield _pair_rows(np.full(int(keep.sum()), record[x]), record[some][keep], agreed[keep])


def _sharpened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, shingles) to (record, n, sketch, tokens)."""
    for batch in batches:
        sketches, sizes, tokens = [], [], []
        for value in batch.column(1):
            found = np.frombuffer(value.as_buffer(), np.uint64)
            bits = np.zeros(SHARP_BITS, bool)
            bits[(found % np.uint64(SHARP_BITS)).astype(np.int64)] = True
            sketches.append(np.packbits(bits).tobytes())
            sizes.append(len(found))
            tokens.append(W.mixed(found[:LEAST_TOKENS]).astype(np.uint32).tobytes())
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(tokens, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["record", "n", "sketch", "tokens"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sizes, sharp sketches) to the pairs that can be linked."""
    for batch in batches:
        if batch.num_rows:
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            keep = _fit(na, nb, *(_fixed(batch.column(k), SHARP_BITS // 8) for k in (4, 5)))
            yield batch.select([0, 1]).filter(pa.array(keep))


def _sets(bits_shared):
    """(text key, text) to (class, shingles) where the filter has the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bits_shared.value, set()
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, batch.column(0).to_numpy(zero_copy_only=False))))
            for part in W.slices(batch, 1):
                classes, sets = [], []
                for found in W.shingle_sets(part.column(1)):
                    if len(found) and (name := xxhash.xxh3_128_digest(found.data)) not in seen:
                        seen.add(name)
                        classes.append(name)
                        sets.append(found.tobytes())
                if len(seen) > 200_000:
                    seen.clear()
                if classes:
                    yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(sets, pa.binary())], ["class", "shingles"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, two sets) to the pairs that are linked."""
    for batch in batches:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            shared = int((y[at] == x).sum())
            keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


class _Join:
    """The state of one join: the records, and the edges and components verified so far."""

    def __init__(self, docs: DataFrame, records: DataFrame, text: str):
        self.docs, self.records, self.text = docs, records, text
        self.about = records.select("record", "n", "sketch")
        self.edges: DataFrame | None = None
        self.roots: DataFrame | None = None

    def _shingles(self, wanted: DataFrame) -> DataFrame:
        """(record, shingles) of the records."""
        keys = landed(wanted.join(self.records.select("record", "class", "key"), "record"))
        shared = self.docs.sparkSession.sparkContext.broadcast(key_filter(keys))
        keyed = self.docs.select(F.xxhash64(self.text).alias("key"), F.col(self.text).cast("string"))
        sets = keyed.mapInArrow(_sets(shared), "class binary, shingles binary").dropDuplicates(["class"])
        out = landed(sets.join(keys.select("class", "record"), "class").select("record", "shingles"))
        shared.destroy()
        return out

    def sharp(self, wanted: DataFrame) -> DataFrame:
        """(record, n, sketch, tokens) of the records: sharper sketches, and their least shingles."""
        return landed(self._shingles(wanted).mapInArrow(_sharpened, "record long, n long, sketch binary, tokens binary"))

    def possible(self, pairs: DataFrame, about: DataFrame) -> DataFrame:
        """The pairs that can be linked by their sketches."""
        for side in ("a", "b"):
            names = zip(("record", "n", "sketch"), (side, f"n_{side}", f"sketch_{side}"), strict=True)
            pairs = pairs.join(about.select(*[F.col(c).alias(n) for c, n in names]), side)
        return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_possible, "a long, b long")

    def verify(self, pairs: DataFrame) -> None:
        """Add the pairs that are linked to the edges."""
        sets = self._shingles(_ends(pairs))
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("record").alias(side), F.col("shingles").alias(f"set_{side}")), side)
        good = landed(pairs.select("a", "b", "set_a", "set_b").mapInArrow(_verified, "a long, b long"))
        self.edges = good if self.edges is None else self.edges.unionByName(good)
        self.roots = landed(components(self.edges, EDGES_PER_TASK).coalesce(1 + self.edges.count() // EDGES_PER_TASK))

    def placed(self, rows: DataFrame, *names: str) -> DataFrame:
        """``rows`` with the component of each named record."""
        for name in names:
            if self.roots is None:
                rows = rows.withColumn(f"root_{name}", F.col(name))
            else:
                own = self.roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
                rows = rows.join(own, name, "left").withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))
        return rows

    def grouped(self, level: DataFrame) -> DataFrame:
        """Rows (node, record, root, size, main, others) of nodes that hold several components: the node's largest component, and
        how many of its rows are of others."""
        parts = level.groupBy("node", "root").agg(F.count("*").alias("rows"))
        sizes = parts.groupBy("node").agg(F.sum("rows").alias("size"), F.max(F.struct("rows", "root")).alias("most"))
        open_nodes = sizes.select("node", "size", F.col("most.root").alias("main"), (F.col("size") - F.col("most.rows")).alias("others"))
        return landed(level.join(landed(open_nodes.where("others > 0")), "node"))

    def compared(self, rows: DataFrame, about: DataFrame, width: int) -> DataFrame:
        """Pairs (a, b, agreed) of different components that can be linked: within small nodes, and within parts of large ones."""
        part = F.pmod(F.xxhash64("record", "node"), F.ceil(F.col("size") / SMALL))
        node = F.when(F.col("size") <= SMALL, F.col("node")).otherwise(F.xxhash64("node", part))
        return (
            rows.withColumn("node", node)
            .join(about, "record")
            .select("node", "record", "root", "n", "sketch")
            .repartition("node")
            .sortWithinPartitions("node", "record")
            .mapInArrow(_compared(width), "a long, b long, agreed long")
        )

    def against(self, rows: DataFrame, about: DataFrame) -> DataFrame:
        """Pairs of large nodes' few records outside the main component with all other records of the node."""
        own = rows.where((F.col("size") > SMALL) & (F.col("others") <= FEW))
        parts = F.ceil(F.col("size") / TOGETHER).cast("long")
        is_main = F.col("root") == F.col("main")
        about = about.select("record", "n", "sketch")
        place = F.when(is_main, F.array(F.pmod(F.xxhash64("record"), parts))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
        spread = own.select("node", is_main.alias("is_main"), "record", "root", F.explode(place).alias("part"))
        return (
            spread.join(about, "record")
            .select(F.xxhash64("node", "part").alias("node"), "is_main", "record", "root", "n", "sketch")
            .repartition("node")
            .sortWithinPartitions("node", "is_main")
            .mapInArrow(_against, "a long, b long, agreed long")
        )

    def below(self, rows: DataFrame, about: DataFrame, levels: int) -> DataFrame:
        """The rows in the nodes ``levels`` below theirs."""
        own = rows.select("node", "record", "root").join(about.select("record", "tokens"), "record")
        split = own.select("node", "record", "root", "tokens").mapInArrow(_branches(levels), "node long, record long, root long")
        return landed(split.distinct())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("record")).distinct()


def _linked(join: _Join) -> None:
    """Follow the trees down until every node is small, or few of its records are outside one component; verify what meets."""
    level = join.records.select("record", "tokens").mapInArrow(_roots, "node long, record long").withColumn("root", F.col("record"))
    rows = join.grouped(level)
    pairs = landed(join.compared(rows, join.about, WIDTH).groupBy("a", "b").agg(F.max("agreed").alias("agreed")))
    if not pairs.isEmpty():
        sided = pairs.select("a", "b", "agreed", F.explode(F.array("a", "b")).alias("record"))
        best = sided.groupBy("record").agg(F.max(F.struct("agreed", "a", "b")).alias("best"))
        first = landed(best.select("best.a", "best.b").distinct())
        join.verify(first)
        left = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
        pairs = landed(join.placed(left, "a", "b").where("root_a <> root_b").select("a", "b"))
        if not pairs.isEmpty():
            join.verify(landed(join.possible(pairs, join.sharp(_ends(pairs)))))
    large = rows.where(F.col("size") > SMALL).select("node", "record")
    if not large.isEmpty():  # components may have closed nodes
        rows = join.grouped(join.placed(large, "record").withColumnRenamed("root_record", "root"))
        about, levels, met = join.sharp(rows.select("record").distinct()), 1, []
        while not rows.isEmpty():
            found = join.compared(rows.where(F.col("size") <= SMALL), about, SHARP_BITS // 8).unionByName(join.against(rows, about))
            met.append(landed(found.select("a", "b").distinct()))
            rows = join.grouped(join.below(rows.where((F.col("size") > SMALL) & (F.col("others") > FEW)), about, levels))
            levels = min(2 * levels, DEEPEST)
        if met:
            rest = landed(reduce(DataFrame.unionByName, met).distinct())
            if not rest.isEmpty():
                join.verify(rest)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (least id reachable by links) and ``kept`` (it is that row's id)."""
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).cast("string"))
    members = landed(source.mapInArrow(_profile, "id long, key long, class binary, n long, tokens binary, sketch binary"))
    of_class = (
        members.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(*[F.max(c).alias(c) for c in ("n", "tokens", "sketch")], F.min("key").alias("key"), F.min("id").alias("least"))
    )
    records = landed(of_class.withColumn("record", F.monotonically_increasing_id()))
    join = _Join(docs, records, text)
    _linked(join)
    placed = landed(join.placed(records.select("class", "record", "least"), "record"))
    by_root = landed(placed.groupBy("root_record").agg(F.min("least").alias("component_id")))
    named = landed(placed.join(by_root, "root_record").select("class", "component_id"))
    rows = members.select("id", "class", "n").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
