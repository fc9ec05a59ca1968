"""Chat formatting by perspective rotation, with built-in functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all
others as named users; the spans to learn from are the assistant's own words with their end mark. ``system`` turns are
instructions, not a participant: they are rendered as such in every perspective. A dialogue is returned in blocks of at most
``BLOCK`` turns, so that no row and no task has to hold a whole conversation; ``start`` is where the block begins in
the dialogue, and the mask spans count from the dialogue's beginning, in code points.

Turns are ordered by ``turn`` (NULL last), then speaker, then text, so ties have a defined order; ranks are counted in ranges
of turn numbers, so that a conversation with most of the rows is not ranked in one task. A NULL role is the speaker
``unknown``, a NULL text is empty, rows with NULL ``conv_id`` form one conversation. Repeated rows are turns of their own. A mark
inside a text is broken up by a blank, so that no text can pretend to be a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns per block.
BLOCK = 64
#: Turn numbers that are ranked together.
TURN_RANGE = 1024
SYSTEM = "system"
UNKNOWN = "unknown"
END = "<|end|>\n"


def safe(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|", "< |")


def ranked_turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id``, ``speaker``, ``body`` and the turn's ``rank`` in its conversation, from 0."""
    turns = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("speaker"), safe(F.col(text)).alias("body")
    ).withColumn("range", F.coalesce(F.floor(F.col("turn") / TURN_RANGE), F.lit((1 << 62) - 1)))
    sizes = turns.groupBy("conv_id", "range").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_last(), "speaker", "body")
    placed = turns.withColumn("inside", F.row_number().over(inside) - 1)
    return placed.join(before, placed["conv_id"].eqNullSafe(before["c"]) & (placed["range"] == before["r"])).select(
        "conv_id", "speaker", "body", (F.col("before") + F.col("inside")).alias("rank")
    )


def rotated(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """A row per conversation, perspective and block: ``conv_id``, ``perspective``, ``block``, ``start``, ``n_turns``,
    ``dialogue`` (the block's text) and ``masks`` (``from-to`` spans to learn from, joined by commas)."""
    turns = ranked_turns(rows, conv_id, turn, role, text)
    people = (
        rows.select(F.col(conv_id).alias("of"), F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("perspective")).where(F.col("perspective") != SYSTEM).distinct()
    )
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).otherwise(
        F.concat(F.lit("<|user name="), safe(F.col("speaker")), F.lit("|>\n"))
    )
    segments = turns.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id",
        "perspective",
        F.floor(F.col("rank") / block).alias("block"),
        "rank",
        own.alias("own"),
        F.length(head).alias("head"),
        F.concat(head, F.col("body"), F.lit(END)).alias("segment"),
    )
    in_block = Window.partitionBy("conv_id", "perspective", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.withColumn("at", F.coalesce(F.sum(F.length("segment")).over(in_block), F.lit(0)))
    blocks = parts.groupBy("conv_id", "perspective", "block").agg(
        F.sort_array(F.collect_list(F.struct("rank", "segment", "own", "at", "head"))).alias("parts"), F.sum(F.length("segment")).alias("length")
    )
    lengths = segments.groupBy("conv_id", "perspective", "block").agg(F.sum(F.length("segment")).alias("length"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start")
    )
    here = blocks["conv_id"].eqNullSafe(starts["c"]) & (blocks["perspective"] == starts["p"]) & (blocks["block"] == starts["b"])
    span = lambda x: F.concat_ws("-", F.col("start") + x["at"] + x["head"], F.col("start") + x["at"] + F.length(x["segment"]))
    return blocks.join(starts, here).select(
        "conv_id",
        "perspective",
        "block",
        "start",
        F.size("parts").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("dialogue"),
        F.array_join(F.transform(F.filter("parts", lambda x: x["own"]), span), ",").alias("masks"),
    )
