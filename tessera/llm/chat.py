"""Chat formatting: cumulative snapshots are collapsed, then whole conversations rendered. DataFrame operations only.

A log that stores a conversation after each turn holds many conversations that are prefixes of
longer ones. Each turn gives two 64-bit hashes of its place, role and text; their running
exclusive or is the hash of each prefix. A conversation whose whole hash is a proper prefix of
another is dropped by an anti-join; of equal ones the smallest conv_id stays.

Only hashes travel in the search. Prefixes and wholes are made distinct in aggregates before
they meet, so a first turn or a conversation that a third of the log repeats is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import materialize

START, END = "<|im_start|>", "<|im_end|>"
HASH = ["n", "h1", "h2"]


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no other one prolongs.

    ``turns``: conv_id, turn, role, text. Turns come in the order of (turn, role, text), nulls
    first, and count by that order, not by their numbers. Null roles and texts equal each other
    and differ from empty ones. Rows with a null conv_id form one conversation.
    """
    ordered = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    told = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    # Rows that agree in all three are equal, so their order doesn't matter.
    rows = turns.select("conv_id", "turn", "role", "text", F.row_number().over(ordered).alias("n"))
    placed = rows.select("conv_id", "n", F.xxhash64(F.lit(1), *told).alias("t1"), F.xxhash64(F.lit(2), *told).alias("t2"))
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    prefix = {k: F.bit_xor(F.xxhash64(F.lit(s), "n", t)).over(upto) for k, s, t in (("h1", 3, "t1"), ("h2", 4, "t2"))}
    last = F.lead("n").over(Window.partitionBy("conv_id").orderBy("n")).isNull()
    prefixes = materialize(placed.withColumns(prefix).withColumn("whole", last).select("conv_id", *HASH, "whole"), "chat-prefixes")
    longer = prefixes.where("NOT whole").select(*HASH).distinct()
    wholes = prefixes.where("whole").groupBy(*HASH).agg(F.min("conv_id").alias("conv_id"))
    return wholes.join(longer, HASH, "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def _plain(text: Column) -> Column:
    """A turn's own control strings lose their bars, so that it can't open or close a turn."""
    return F.replace(F.replace(text, F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of the kept conversations.

    Each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; a null role is written ``unknown``, a
    null text as an empty one.
    """
    of = kept.select(F.col("conv_id").alias("of"), "n_turns")
    mine = turns.select("conv_id", "turn", "role", "text").join(of, F.col("conv_id").eqNullSafe(F.col("of")))
    told = F.transform("all", lambda t: F.concat(F.lit(START), _plain(F.coalesce(t.role, F.lit("unknown"))), F.lit("\n"), _plain(F.coalesce(t.text, F.lit(""))), F.lit(f"{END}\n")))
    return mine.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all")).select("conv_id", "n_turns", F.array_join(told, "").alias("rendered"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered."""
    return render(turns, maximal_conversations(turns))
