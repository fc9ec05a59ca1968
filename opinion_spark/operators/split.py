"""Reproducible train/test and k-fold splits.

A row's place in a split is decided by ``md5(seed:id)``. "The k rows of smallest hash"
is found without sorting: hashes are counted per 4-digit prefix (at most 65,536 per
group), the prefix that contains the k-th hash is located, and only the hashes under that
prefix are ranked. Rows that share an id fall on the same side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinion_spark.operators.reshape import with_ordinal

_PREFIX = 4


def split_hash(id_col: str, seed: Column | int) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", seed.cast("string"), F.col(id_col).cast("string")))


def _cut_hashes(hashed: DataFrame, groups: list[str], quotas: DataFrame) -> DataFrame:
    """``(*groups, cut)``: the hash of rank ``quota`` in every group.

    ``hashed`` has ``(*groups, h)``; ``quotas`` has ``(*groups, quota)``, one short row
    per group. The windows run over prefixes and over the hashes under one prefix.
    """
    by_prefix = hashed.withColumn("p", F.substring("h", 1, _PREFIX))
    upto = Window.partitionBy(*groups).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    counted = by_prefix.groupBy(*groups, "p").agg(F.count("*").alias("n"))
    running = counted.withColumn("upto", F.sum("n").over(upto))
    if groups:
        running = running.join(F.broadcast(quotas), groups)
    else:
        running = running.withColumn("quota", quotas.select("quota").scalar())
    edge = running.where(
        (F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota"))
    )
    edge = edge.select(*groups, "p", (F.col("quota") - F.col("upto") + F.col("n")).alias("rank"))
    near = by_prefix.join(F.broadcast(edge), [*groups, "p"])
    # Counting per hash first keeps repeated ids from piling up in one window.
    near = near.groupBy(*groups, "rank", "h").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*groups).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    reached = near.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= F.col("rank"))
    return reached.groupBy(*groups).agg(F.min("h").alias("cut"))


def train_test_split(
    df: DataFrame, id_col: str, test_size: float = 0.1, seed: int = 109, exact: bool = True
) -> DataFrame:
    """Add ``is_test``.

    ``exact``: precisely ``ceil(test_size * n)`` test rows. Otherwise each row is tested
    against a hash threshold on its own, in one narrow pass, and the size is approximate.
    """
    h = split_hash(id_col, seed)
    if not exact:
        uniform = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
        return df.withColumn("is_test", uniform < test_size)
    quota = df.agg(F.ceil(F.count("*") * test_size).alias("quota"))
    cut = _cut_hashes(df.select(h.alias("h")), [], quota).scalar()
    return df.withColumn("is_test", F.coalesce(h <= cut, F.lit(False)))


def stratified_quotas(df: DataFrame, label: str, test_size: float = 0.1) -> DataFrame:
    """``(label, n, quota)``: test rows per class."""
    return class_quotas(df.groupBy(label).agg(F.count("*").alias("n")), label, test_size)


def class_quotas(classes: DataFrame, label: str, test_size: float = 0.1) -> DataFrame:
    """``(label, n, quota)`` from class sizes ``(label, n)``.

    The training rows are shared out in proportion to the class sizes, what is left over
    goes to the largest remainders (ties in label order); the rest of a class is its
    test part. The arithmetic runs on one row holding the class list.
    """
    listed = classes.agg(
        F.collect_list(F.struct(F.col(label).alias("label"), "n")).alias("c"),
        F.sum("n").alias("total"),
    )
    train_total = F.col("total") - F.ceil(F.col("total") * test_size)

    def share(c: Column) -> Column:
        # n * train exceeds 64 bits for large tables.
        product = c["n"].cast("decimal(19,0)") * F.col("train").cast("decimal(19,0)")
        rest = F.pmod(product, F.col("total").cast("decimal(19,0)"))
        base = (product - rest) / F.col("total").cast("decimal(19,0)")
        return F.struct(
            (-rest).alias("rest"),
            c["label"].alias("label"),
            c["n"].alias("n"),
            base.cast("long").alias("base"),
        )

    shared = listed.withColumn("train", train_total.cast("long")).withColumn(
        "c", F.sort_array(F.transform("c", share))
    )
    floors = F.aggregate("c", F.lit(0).cast("long"), lambda acc, c: acc + c["base"])
    placed = shared.withColumn("spare", F.col("train") - floors).select(
        "spare", F.posexplode("c").alias("i", "c")
    )
    extra = (F.col("i") < F.col("spare")).cast("long")
    return placed.select(
        F.col("c.label").alias(label),
        F.col("c.n").alias("n"),
        (F.col("c.n") - F.col("c.base") - extra).alias("quota"),
    )


def stratified_cuts(
    df: DataFrame, id_col: str, label: str, n_splits: int, test_size: float = 0.1
) -> DataFrame:
    """``(split, label, cut)``: a row is test in a split if its hash is not above the cut."""
    numbers = F.sequence(F.lit(1), F.lit(n_splits))
    # A struct around the label: rows without a label are a class like any other.
    rows = df.select(F.struct(F.col(label).alias("of")).alias("class"), F.col(id_col), F.explode(numbers).alias("split"))
    hashed = rows.select("split", "class", split_hash(id_col, F.col("split")).alias("h"))
    quotas = stratified_quotas(df, label, test_size).withColumn("split", F.explode(numbers))
    wrapped = quotas.select("split", F.struct(F.col(label).alias("of")).alias("class"), "quota")
    cuts = _cut_hashes(hashed, ["split", "class"], wrapped)
    return cuts.select("split", F.col("class.of").alias(label), "cut")


def stratified_shuffle_split(
    df: DataFrame, id_col: str, label: str, n_splits: int = 5, test_size: float = 0.1
) -> DataFrame:
    """``(id, label, split, is_test)`` for every row and split, class shares kept."""
    cuts = stratified_cuts(df, id_col, label, n_splits, test_size)
    numbers = F.sequence(F.lit(1), F.lit(n_splits))
    rows = df.select(id_col, label, F.explode(numbers).alias("split"))
    # One cut per split and class.
    of = F.broadcast(cuts.select(F.col("split").alias("_split"), F.col(label).alias("_label"), "cut"))
    marked = rows.join(of, (F.col("split") == F.col("_split")) & F.col(label).eqNullSafe(F.col("_label")), "left")
    is_test = F.coalesce(split_hash(id_col, F.col("split")) <= F.col("cut"), F.lit(False))
    return marked.select(id_col, label, "split", is_test.alias("is_test"))


def with_test_splits(
    df: DataFrame, cuts: DataFrame, id_col: str, label: str, name: str = "test_splits"
) -> DataFrame:
    """Add, per row, the array of splits in which it is a test row.

    The cuts (one per split and class) reach the rows as a scalar sub-query, so rows are
    not multiplied by the number of splits.
    """
    listed = cuts.select(
        F.sort_array(F.collect_list(F.struct("split", F.col(label).alias("label"), "cut")))
    ).scalar()
    mine = F.filter(
        "_cuts",
        lambda c: c["label"].eqNullSafe(F.col(label)) & (split_hash(id_col, c["split"]) <= c["cut"]),
    )
    listed_rows = df.withColumn("_cuts", listed)
    return listed_rows.withColumn(name, F.transform(mine, lambda c: c["split"])).drop("_cuts")


def kfold_contiguous(df: DataFrame, *order_by: str, folds: int = 10) -> DataFrame:
    """Add ``fold`` (0-based): contiguous blocks in row order, the first ones one longer."""
    ranked = with_ordinal(df, *order_by, name="_ordinal")
    n = F.lit(ranked.count())
    base, longer = F.floor(n / folds), n % folds
    head = longer * (base + 1)
    fold = F.when(
        F.col("_ordinal") < head, F.floor(F.col("_ordinal") / (base + 1))
    ).otherwise(longer + F.floor((F.col("_ordinal") - head) / F.greatest(base, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("_ordinal")
