"""Filters, joins, set operations and ordering that entity services need, as DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- filters ---------------------------------------------------------------------------------


def optional_filter(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality on each named column whose value isn't None; a list means membership."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return df


def incident(edges: DataFrame, ref: str, direction: str = "both", source: str = "from_ref", target: str = "to_ref") -> DataFrame:
    """Edges that leave ``ref``, reach it, or either."""
    out, into = F.col(source) == ref, F.col(target) == ref
    return edges.where({"out": out, "in": into, "both": out | into}[direction])


def contains_ci(column: Column | str, text: str) -> Column:
    """Case-insensitive substring; a null never matches."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))


def free_text(fields: list[str], text: str, spaceless: tuple[str, ...] = ()) -> Column:
    """Any field contains the text; fields in ``spaceless`` are compared without blanks on either side."""
    found = [contains_ci(f, text) for f in fields if f not in spaceless]
    found += [contains_ci(F.replace(F.col(f), F.lit(" "), F.lit("")), text.replace(" ", "")) for f in spaceless]
    return reduce(Column.__or__, found)


def token_filter(identifiers: str, token: str) -> Column:
    """``value`` or ``system|value`` against an array of structs with system and value."""
    system, bar, value = token.rpartition("|")
    return F.exists(identifiers, lambda x: (x["value"] == value) & ((x["system"] == system) if bar and system else F.lit(True)))


def any_part(parts: str, text: str, fields: tuple[str, ...]) -> Column:
    """Some element of an array of structs has a field that contains the text."""
    return F.exists(parts, lambda x: reduce(Column.__or__, [contains_ci(x[f], text) for f in fields]))


def live(df: DataFrame, deleted: str = "deleted_at", active: str | None = "active") -> DataFrame:
    """Rows that are neither deleted nor inactive."""
    df = df.where(F.col(deleted).isNull())
    return df.where(active) if active else df


def json_equals(column: str, path: str, value: str) -> Column:
    """Whether the JSON in a column has the value, as text, at a path; false where it is malformed or has none."""
    return F.coalesce(F.get_json_object(column, path) == value, F.lit(False))


def visible(df: DataFrame, sensitive: Column, may_see: Column, may_see_masked: Column, masks: dict[str, Column]) -> DataFrame:
    """Rows that a reader may see: all that aren't sensitive, and sensitive ones whole or, where only so allowed, with the masks."""
    masked = sensitive & ~may_see
    return df.where(~sensitive | may_see | may_see_masked).withColumns({c: F.when(masked, m).otherwise(F.col(c)) for c, m in masks.items()})


def check_moves(moves: DataFrame, allowed: list[tuple[str, str]], before: str = "from_state", after: str = "to_state") -> DataFrame:
    """``moves`` with ``valid``: whether the move is among the allowed pairs."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in allowed])
    return moves.withColumn("valid", F.coalesce(F.array_contains(pairs, F.struct(F.col(before).alias("a"), F.col(after).alias("b"))), F.lit(False)))


# --- joins -----------------------------------------------------------------------------------


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row a key: the first in ``order``."""
    n = "__n"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The row of each key with the largest ``at``; of equal ones, the largest ``tie``. An aggregate, so the map side halves the rows first."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r"))
    return picked.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side alone: ``side`` is missing (not in ``right``) or extra (not in ``left``)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``old`` by key; a null in a new row keeps the old value."""
    rest = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in rest])
    return old.join(renamed, keys, "full_outer").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in rest])


def refresh_reviews(queue: DataFrame, scan: DataFrame) -> DataFrame:
    """Review pairs (a, b, score, status) after a new scan.

    The score is refreshed. A pair someone decided keeps its status; one merged by machine falls
    back to pending where the scan says pending; new pairs come in as scanned.
    """
    s = scan.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("score").alias("__score"), F.col("status").alias("__status")).dropDuplicates(["a", "b"])
    kept = F.when(F.col("status").isNull() | F.col("status").isin("pending", "automerged"), F.coalesce("__status", "status")).otherwise(F.col("status"))
    return queue.join(s, ["a", "b"], "full_outer").select("a", "b", F.coalesce("__score", "score").alias("score"), kept.alias("status"))


def blocked_pairs(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows that share a block key; null and empty keys make no pair.

    ``blocks`` is an array. A block with more than a few thousand members should be keyed more
    finely: the pairs of a block are the operator's result, so they grow with its square.
    """
    rows = df.select(F.col(key).alias("k"), F.explode(F.array_distinct(blocks)).alias("block")).where("block IS NOT NULL AND block != ''")
    other = rows.withColumnRenamed("k", "j")
    return rows.join(other, "block").where("k < j").select(F.col("k").alias("a"), F.col("j").alias("b")).distinct()


def block_stars(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Pairs (a, b) of each block's smallest row with its others: they connect what :func:`blocked_pairs` connects, at the size of the blocks."""
    rows = df.select(F.col(key).alias("b"), F.explode(F.array_distinct(blocks)).alias("block")).where("block IS NOT NULL AND block != ''")
    return rows.join(rows.groupBy("block").agg(F.min("b").alias("a")), "block").where("a < b").select("a", "b").distinct()


def transition_gaps(moves: DataFrame, place: DataFrame, node: str, parent: str, levels: int) -> DataFrame:
    """For moves (from_node, to_node), the ancestor of either end ``levels`` up a containment table."""
    up = place.select(F.col(node).alias("n"), F.col(parent).alias("p"))
    for end in ("from", "to"):
        moves = moves.withColumn(f"{end}_top", F.col(f"{end}_node"))
        for _ in range(levels):
            moves = moves.join(up, F.col(f"{end}_top") == F.col("n"), "left").withColumn(f"{end}_top", F.col("p")).drop("n", "p")
    return moves


# --- lists and order -------------------------------------------------------------------------


def list_union(main: str, other: str) -> Column:
    """The main list in its order, then what the other adds."""
    return F.array_union(F.coalesce(main, F.array()), F.coalesce(other, F.array()))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Intersection over union of two arrays as sets; null if either is null, and for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either)


def page(df: DataFrame, order: list[str], after: tuple | None, limit: int, most: int = 500) -> DataFrame:
    """Keyset paging: rows behind ``after`` in the order of the columns, ``limit`` clamped to 1..``most``."""
    if after is not None:
        df = df.where(F.struct(*order) > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, after)]))
    return df.orderBy(*order).limit(max(1, min(limit, most)))


def ranked(df: DataFrame, *order: Column | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``rank`` by the order within the keys."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
