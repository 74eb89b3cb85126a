"""Rules of the form ``type:value`` over rows of journey features, and what limits a flow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The column of each type of rule: lists are searched, others compared.
LISTS = {"stage": "stages", "step": "steps", "event": "events", "waste": "wastes"}
VALUES = {"outcome": "outcome", "setting": "setting", "urgency": "urgency"}


def parse_rule(text: str, vocabularies: dict[str, set[str]]) -> tuple[str, str]:
    """Type and value; ValueError for another form, an unknown type, or a value outside the type's vocabulary (any, if it has none)."""
    kind, colon, value = text.partition(":")
    if not colon or not value:
        raise ValueError(f"not of the form type:value: {text}")
    if kind not in LISTS and kind not in VALUES:
        raise ValueError(f"unknown type: {kind}")
    if kind in vocabularies and value not in vocabularies[kind]:
        raise ValueError(f"unknown {kind}: {value}")
    return kind, value


def matches(contains: list[str], excludes: list[str], vocabularies: dict[str, set[str]] | None = None) -> Column:
    """Rows that meet all of ``contains`` and none of ``excludes``; without rules every row. Missing values meet no rule."""

    def test(text: str) -> Column:
        kind, value = parse_rule(text, vocabularies or {})
        found = F.array_contains(LISTS[kind], value) if kind in LISTS else F.col(VALUES[kind]) == value
        return F.coalesce(found, F.lit(False))

    return reduce(Column.__and__, [test(t) for t in contains] + [~test(t) for t in excludes], F.lit(True))


def findings(waste: DataFrame, gaps: DataFrame, share: float = 0.5) -> DataFrame:
    """What holds a flow up, by the time that could be won: rank, rule, subject, recoverable_ms.

    ``waste`` (stage, ms): a stage with more than ``share`` of all wasted time dominates it.
    ``gaps`` (after_stage, stage, gap_ms): the handover that loses the most time in all.
    """
    total = waste.agg(F.sum("ms").alias("total"))
    stages = waste.crossJoin(F.broadcast(total)).where(F.col("ms") > share * F.col("total"))  # one row
    stages = stages.select(F.lit("stage_dominates_waste").alias("rule"), F.col("stage").alias("subject"), F.col("ms").alias("recoverable_ms"))
    lost = gaps.groupBy(F.concat_ws(">", "after_stage", "stage").alias("subject")).agg(F.sum("gap_ms").alias("recoverable_ms"))
    longest = lost.orderBy(F.desc("recoverable_ms"), "subject").limit(1).select(F.lit("longest_gap").alias("rule"), "subject", "recoverable_ms")
    both = stages.unionByName(longest)
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("recoverable_ms"), "rule", "subject")))  # a row a stage at most
