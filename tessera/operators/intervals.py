"""Time-based analysis of journeys: interval unions, gaps, elapsed-time partitions, survival and flow.

Segments are rows (instance, stage, category, start_ms, end_ms); a null end is open and ends at
``as_of``. All arithmetic is in milliseconds; only results are divided into days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_MS = 86_400_000


def clock(instances: DataFrame, as_of_ms: int, start: str = "clock_start_ms", enrolled: str = "enrolled_ms", stop: str = "clock_stop_ms", closed: str = "closed_ms") -> DataFrame:
    """Adds t0 and t1, the clock of each instance, and where its stop comes from."""
    return instances.withColumns({
        "t0": F.coalesce(start, enrolled), "t1": F.coalesce(F.col(stop), F.col(closed), F.lit(as_of_ms)),
        "stop_source": F.when(F.col(stop).isNotNull(), "clock_stop_at").when(F.col(closed).isNotNull(), "closed_on").otherwise("as_of"),
    })


def clip(segments: DataFrame, clocks: DataFrame, key: str, as_of_ms: int) -> DataFrame:
    """Segments cut to their instance's clock (t0, t1); what lies outside goes."""
    end = F.coalesce(F.col("end_ms"), F.lit(as_of_ms))
    cut = segments.join(clocks.select(key, "t0", "t1"), key).withColumns({"start_ms": F.greatest("start_ms", "t0"), "end_ms": F.least(end, F.col("t1"))})
    return cut.where("end_ms > start_ms")


def islands(segments: DataFrame, *keys: str) -> DataFrame:
    """The union of each key's segments as disjoint islands (keys, island, start_ms, end_ms); touching ones merge.

    One window pass: a row opens an island where it starts behind all earlier ends.
    """
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_ms") > reach), 1).otherwise(0)
    numbered = segments.withColumn("__o", opens).withColumn("island", F.sum("__o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def covered(segments: DataFrame, name: str, *keys: str) -> DataFrame:
    """Length of the union of each key's segments."""
    return islands(segments, *keys).groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(name))


def elapsed_parts(segments: DataFrame, clocks: DataFrame, key: str) -> DataFrame:
    """lead_ms split exactly into va, nnva, unva and unrecorded, with touch time and ratios over lead time.

    Where categories overlap the more valuable one counts: VT is the union of VA, PT that of VA and
    NNVA. Unknown categories count as UNVA.
    """
    rank = F.when(F.col("category") == "VA", 1).when(F.col("category") == "NNVA", 2).otherwise(3)
    before = Window.partitionBy(key).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.select(key, "start_ms", "end_ms", rank.alias("__rank"))
    names = {1: "vt_ms", 2: "pt_ms", 3: "all_ms"}
    # What a segment adds to the union of its rank and below lies beyond the furthest end before it; one sort serves all three.
    reached = {f"__to{k}": F.max(F.when(F.col("__rank") <= k, F.col("end_ms"))).over(before) for k in names}
    s = s.withColumns(reached)
    adds = lambda k: F.when(F.col("__rank") <= k, F.greatest(F.col("end_ms") - F.greatest(F.col("start_ms"), F.coalesce(f"__to{k}", "start_ms")), F.lit(0)))
    sums = s.groupBy(key).agg(*(F.sum(adds(k)).alias(n) for k, n in names.items()), F.sum(F.when(F.col("__rank") <= 2, F.col("end_ms") - F.col("start_ms"))).alias("touch_ms"))
    out = clocks.select(key, (F.col("t1") - F.col("t0")).alias("lead_ms")).join(sums, key, "left").na.fill(0, ["vt_ms", "pt_ms", "all_ms", "touch_ms"])
    share = lambda c: F.when(F.col("lead_ms") > 0, F.round(F.col(c) / F.col("lead_ms"), 9))
    return out.select(
        key, "lead_ms", F.col("vt_ms").alias("va_ms"), (F.col("pt_ms") - F.col("vt_ms")).alias("nnva_ms"), (F.col("all_ms") - F.col("pt_ms")).alias("unva_ms"),
        (F.col("lead_ms") - F.col("all_ms")).alias("unrecorded_ms"), "touch_ms", share("vt_ms").alias("va_ratio"), share("pt_ms").alias("pt_ratio"), share("all_ms").alias("coverage"),
    )


def confidence(coverage: str, unmapped: float = 0.2, mapped: float = 0.8) -> Column:
    """unmapped, partial or mapped by covered share; the bounds are parameters with assumed defaults."""
    return F.when(F.col(coverage) < unmapped, "unmapped").when(F.col(coverage) < mapped, "partial").otherwise("mapped")


def gaps(segments: DataFrame, key: str) -> DataFrame:
    """Idle time between islands, charged to the stage it precedes; ``handoff`` if the stage changes there."""
    order = Window.partitionBy(key).orderBy("start_ms", "end_ms", "stage")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_ms").over(before)
    last = F.max_by("stage", F.struct("end_ms", "start_ms", "stage")).over(before)
    found = segments.select(key, "stage", "start_ms", reach.alias("from_ms"), last.alias("after_stage")).where("start_ms > from_ms")
    return found.select(key, "after_stage", "stage", "from_ms", F.col("start_ms").alias("to_ms"), (F.col("start_ms") - F.col("from_ms")).alias("gap_ms"), (F.col("after_stage") != F.col("stage")).alias("handoff"))


def process_map(segments: DataFrame, key: str, start: str = "(start)", end: str = "(end)") -> DataFrame:
    """Directly-follows edges with pseudo-nodes: from, to, n, instances, mean gap from end to start."""
    order = Window.partitionBy(key).orderBy("start_ms", "end_ms", "stage")
    s = segments.select(key, "stage", "start_ms", "end_ms", F.lead("stage").over(order).alias("next"), F.lead("start_ms").over(order).alias("next_ms"), F.lag("stage").over(order).alias("prev"))
    pairs = s.select(key, F.explode(F.array_compact(F.array(
        F.when(F.col("prev").isNull(), F.struct(F.lit(start).alias("from"), F.col("stage").alias("to"), F.lit(None).cast("long").alias("gap"))),
        F.struct(F.col("stage").alias("from"), F.coalesce("next", F.lit(end)).alias("to"), (F.col("next_ms") - F.col("end_ms")).alias("gap")),
    ))).alias("e"))
    return pairs.groupBy(F.col("e.from").alias("from_stage"), F.col("e.to").alias("to_stage")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("instances"), F.round(F.avg("e.gap") / DAY_MS, 6).alias("mean_gap_days"))


def anchors(segments: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """First start of each named stage (null if unreached) and the days from each to the next, not below 0."""
    first = segments.groupBy(key).agg(*[F.min(F.when(F.col("stage") == s, F.col("start_ms"))).alias(s) for s in stages])
    days = [F.round(F.greatest(F.col(b) - F.col(a), F.lit(0)) / DAY_MS, 6) for a, b in zip(stages, stages[1:])]
    return first.select(key, *stages, *[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), d).alias(f"{a}_to_{b}") for (a, b), d in zip(zip(stages, stages[1:]), days)])


def compliance(days: DataFrame, column: str, threshold: float, target: float) -> DataFrame:
    """Counts within, breached and unreached (null) against a standard, and whether the share meets its target."""
    n = days.agg(F.count_if(F.col(column) <= threshold).alias("within"), F.count_if(F.col(column) > threshold).alias("breached"), F.count_if(F.col(column).isNull()).alias("unreached"))
    reached = F.col("within") + F.col("breached")
    return n.withColumn("share", F.when(reached > 0, F.round(F.col("within") / reached, 9))).withColumn("met", F.col("share") >= target)


def kaplan_meier(rows: DataFrame, time: str, event: str, *groups: str) -> DataFrame:
    """The survival curve: time, at_risk, events, survival at each time with an event; censored rows leave after it.

    Counts by time come first, so the windows run over distinct times and not over rows.
    """
    by = rows.groupBy(*groups, time).agg(F.count(F.lit(1)).alias("n"), F.count_if(event).alias("events"))
    order = Window.partitionBy(*groups).orderBy(time)
    risk = F.sum("n").over(Window.partitionBy(*groups)) - F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = by.withColumn("at_risk", risk).withColumn("__f", F.when(F.col("events") == F.col("at_risk"), None).otherwise(F.log1p(-F.col("events") / F.col("at_risk"))))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    done = F.max(F.col("__f").isNull()).over(upto)
    survival = F.when(done, 0.0).otherwise(F.exp(F.sum(F.coalesce("__f", F.lit(0.0))).over(upto)))
    return step.withColumn("survival", F.round(survival, 9)).where("events > 0").select(*groups, time, "at_risk", "events", "survival")


def survival_quantile(curve: DataFrame, time: str, p: float, *groups: str) -> DataFrame:
    """First time at which survival is at most 1 - p; null where the curve never falls so far."""
    return curve.groupBy(*groups).agg(F.min(F.when(F.col("survival") <= 1 - p, F.col(time))).alias("quantile"))


def log_rank(rows: DataFrame, time: str, event: str, group: str, a: str) -> DataFrame:
    """Mantel-Haenszel test of group ``a`` against the others: observed, expected, variance, chi2."""
    mine = F.col(group) == a
    by = rows.groupBy(time).agg(F.count(F.lit(1)).alias("n"), F.count_if(mine).alias("n1"), F.count_if(event).alias("d"), F.count_if(F.col(event) & mine).alias("d1"))
    order = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)  # one row a distinct time
    whole = Window.partitionBy()
    at = by.select(time, "d", "d1", *[(F.sum(c).over(whole) - F.coalesce(F.sum(c).over(order), F.lit(0))).alias(r) for c, r in (("n", "r"), ("n1", "r1"))])
    e = F.col("d") * F.col("r1") / F.col("r")
    v = F.when(F.col("r") > 1, e * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    s = at.where("d > 0").agg(F.sum("d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    chi2 = F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance"))
    return s.select("observed", F.round("expected", 6).alias("expected"), F.round("variance", 6).alias("variance"), F.round(chi2, 6).alias("chi2"))


def little_law(instances: DataFrame, from_ms: int, to_ms: int, opened: str = "t0", closed: str = "closed_ms") -> DataFrame:
    """Arrivals and closures of a period, their daily rates, utilisation, work in progress and the lead time it implies."""
    days = (to_ms - from_ms) / DAY_MS
    o, c = F.col(opened), F.col(closed)
    inside = lambda x: (x >= from_ms) & (x < to_ms)
    n = instances.agg(
        F.count_if(inside(o)).alias("arrivals"), F.count_if(inside(c)).alias("closures"), F.count_if((o < to_ms) & (c.isNull() | (c >= to_ms))).alias("wip"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN {closed} >= {from_ms} AND {closed} < {to_ms} THEN ({closed} - {opened}) / {DAY_MS}D END)").alias("observed_days"),
    )
    rate, done = F.col("arrivals") / days, F.col("closures") / days
    implied = F.when(rate > 0, F.col("wip") / rate)
    label = F.when(implied.isNull() | F.col("observed_days").isNull(), "insufficient_data").when(implied < F.col("observed_days") * 0.9, "queue_draining").when(implied > F.col("observed_days") * 1.1, "queue_growing").otherwise("steady")
    return n.select(
        "arrivals", "closures", F.round(rate, 6).alias("arrival_rate"), F.round(done, 6).alias("service_rate"), F.when(done > 0, F.round(rate / done, 6)).alias("utilisation"),
        "wip", F.round(implied, 6).alias("implied_days"), F.round("observed_days", 6).alias("observed_days"), label.alias("interpretation"),
    )


def step_conformance(steps: DataFrame, key: str) -> DataFrame:
    """Adjacent declared steps: in order, inverted or skipped (either undone); ratio of in-order ones, null without pairs."""
    order = Window.partitionBy(key).orderBy("position")
    s = steps.withColumn("__next", F.lead("done_at").over(order)).withColumn("__has", F.lead("position").over(order).isNotNull()).where("__has")
    both = F.col("done_at").isNotNull() & F.col("__next").isNotNull()
    n = s.groupBy(key).agg(F.count_if(both & (F.col("done_at") <= F.col("__next"))).alias("in_order"), F.count_if(both & (F.col("done_at") > F.col("__next"))).alias("inverted"), F.count_if(~both).alias("skipped"))
    all_ = F.col("in_order") + F.col("inverted") + F.col("skipped")
    return n.withColumn("ratio", F.when(all_ > 0, F.round(F.col("in_order") / all_, 9)))


def out_of_order(steps: DataFrame, key: str) -> DataFrame:
    """Instances whose done steps, undone ones aside, go back in time somewhere."""
    order = Window.partitionBy(key).orderBy("position")
    s = steps.where("done_at IS NOT NULL").withColumn("__prev", F.lag("done_at").over(order))
    return s.groupBy(key).agg(F.bool_or(F.coalesce(F.col("done_at") < F.col("__prev"), F.lit(False))).alias("out_of_order"))


#: Fixed codes of the data-quality report, in the order of their tests.
DQ_CODES = [
    "no_segments", "open_segment_past_closure", "terminal_without_clock_stop", "step_done_before_enrolled",
    "steps_out_of_order", "segment_clipped_by_clock", "coverage_below_floor", "anchors_unreached",
]


def dq_codes(instances: DataFrame, segments: DataFrame, steps: DataFrame, key: str, as_of_ms: int, terminal: list[str], floor: float = 0.2, anchor_pair: tuple[str, str] | None = None) -> DataFrame:
    """key, codes of each instance. ``instances`` needs status, enrolled_ms and :func:`clock`'s columns."""
    end = F.coalesce(F.col("end_ms"), F.lit(as_of_ms))
    s = segments.join(instances.select(key, "t0", "t1"), key).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("end_ms").isNull()).alias("open"), F.bool_or((F.col("start_ms") < F.col("t0")) | (end > F.col("t1"))).alias("clipped"),
        *[F.min(F.when(F.col("stage") == a, F.col("start_ms"))).alias(f"__a{i}") for i, a in enumerate(anchor_pair or ())],
    )
    cover = covered(clip(segments, instances, key, as_of_ms), "all_ms", key)
    early = steps.join(instances.select(key, "enrolled_ms"), key).groupBy(key).agg(F.bool_or(F.coalesce(F.col("done_at") < F.col("enrolled_ms"), F.lit(False))).alias("early"))
    rows = instances.join(s, key, "left").join(cover, key, "left").join(early, key, "left").join(out_of_order(steps, key), key, "left")
    is_terminal, lead = F.col("status").isin(terminal), F.col("t1") - F.col("t0")
    tests = [
        F.col("n").isNull(), is_terminal & (F.col("open") > 0), is_terminal & (F.col("stop_source") != "clock_stop_at"), F.col("early"), F.col("out_of_order"), F.col("clipped"),
        (lead > 0) & (F.coalesce("all_ms", F.lit(0)) / lead < floor), (F.col("__a0").isNull() | F.col("__a1").isNull()) if anchor_pair else F.lit(False),
    ]
    return rows.select(key, F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in zip(DQ_CODES, tests)])).alias("codes"))
