"""Beds, stays and boards: eligibility, state machine, timelines, screening reach and cohort counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.disclosure import FLOOR, small

DAY_MS = 86_400_000

#: Fixed states and moves of a bed, and where a move leads from a state.
STATES = ["available", "reserved", "occupied", "awaiting_clean", "cleaning", "closed"]
MOVES = ["allocate", "release", "admit", "vacate", "clean_start", "clean_complete", "close", "reopen"]
ROUTES = {
    ("available", "allocate"): "reserved", ("reserved", "release"): "available", ("available", "admit"): "occupied", ("reserved", "admit"): "occupied", ("occupied", "vacate"): "awaiting_clean", ("awaiting_clean", "clean_start"): "cleaning",
    ("cleaning", "clean_complete"): "available", ("available", "close"): "closed", ("reserved", "close"): "closed", ("awaiting_clean", "close"): "closed", ("cleaning", "close"): "closed", ("closed", "close"): "closed", ("closed", "reopen"): "available",
}
#: Fixed moves of an enrolment; completed and discontinued ones move no more.
ENROLMENT = [("active", "on_hold"), ("active", "completed"), ("active", "discontinued"), ("on_hold", "active"), ("on_hold", "completed"), ("on_hold", "discontinued")]


def breaches() -> Column:
    """What speaks against a bed for a request, in fixed order, over the columns of both.

    Sex and ward may be overridden; a closed bed, isolation and equipment may not.
    """
    unisex = F.col("bay_sex").isin("mixed", "flexible")
    rules = {
        "not_open": (F.col("state") != "available") | ~F.col("ward_open") | F.col("ward_closed") | F.col("bay_closed"),
        "sex_segregation": ~(F.col("side_room") | unisex | F.coalesce(F.col("sex") == F.col("bay_sex"), F.lit(True)) | F.col("override_sex")),
        "isolation": (F.col("need_side_room") & ~F.col("side_room")) | (F.col("need_isolation") & ~(F.col("side_room") | F.col("isolation_capable"))),
        "equipment": (F.col("need_oxygen") & ~F.col("oxygen")) | (F.col("need_bariatric") & ~F.col("bariatric")),
        "ward_fit": ~(F.coalesce(F.col("ward") == F.col("target_ward"), F.lit(True)) | F.coalesce(F.col("specialty") == F.col("wanted_specialty"), F.lit(True)) | F.col("override_ward")),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def ranked_beds(eligible: DataFrame) -> DataFrame:
    """``rank`` of the eligible beds of each request: the target ward first, side rooms last for those who need none, then by bed."""
    other = F.coalesce(F.col("ward") != F.col("target_ward"), F.lit(False))
    waste = F.col("side_room") & ~(F.col("need_side_room") | F.col("need_isolation"))
    return eligible.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(other, waste, "bed")))


def next_state() -> Column:
    """Struct of the state a move leads to and whether a deep clean is owed; null for a refused move.

    Over state, move, deep_clean, virtual and infectious. A bed that owes a deep clean isn't
    clean after a routine one, and is cleaned again when it reopens; a virtual bed needs none.
    """
    routes = F.create_map(*[F.lit(x) for (a, m), b in ROUTES.items() for x in (f"{a}/{m}", b)])
    to = routes[F.concat_ws("/", "state", "move")]
    vacate, done, reopen = (F.col("move") == m for m in ("vacate", "clean_complete", "reopen"))
    state = F.when(vacate & F.col("virtual"), "available").when(reopen & F.col("deep_clean"), "awaiting_clean").otherwise(to)
    owed = F.when(vacate, ~F.col("virtual") & (F.col("deep_clean") | F.col("infectious"))).when(done, F.lit(False)).otherwise(F.col("deep_clean"))
    return F.when(to.isNotNull() & ~(done & F.col("deep_clean")), F.struct(state.alias("state"), owed.alias("deep_clean")))


def stay_timelines(stays: DataFrame, days: DataFrame, today: str) -> DataFrame:
    """stay, lead_ms, value_ms (green days, the lead time at most), classified_days, green_days, span_days, coverage, confidence.

    ``stays``: stay, admitted_at, discharged_at (null while open). ``days``: stay, day,
    classification, at; a day counts once, by its smallest ``at``, and only inside the stay.
    """
    now = F.lit(today).cast("timestamp_ntz")
    s = stays.select("stay", "admitted_at", F.coalesce(F.col("discharged_at").cast("timestamp_ntz"), now).alias("end")).withColumns({"first": F.to_date("admitted_at"), "last": F.to_date("end")})
    one = days.groupBy("stay", "day").agg(F.min_by("classification", F.struct("at", "classification")).alias("classification"))
    inside = s.select("stay", "first", "last").join(one, "stay").where("day BETWEEN first AND last").groupBy("stay").agg(F.count(F.lit(1)).alias("classified"), F.count_if(F.col("classification") == "green").alias("green"))
    lead = F.expr("greatest(timestampdiff(MILLISECOND, CAST(admitted_at AS TIMESTAMP_NTZ), end), 0)")
    t = s.join(inside, "stay", "left").select(
        "stay", lead.alias("lead_ms"), F.coalesce("classified", F.lit(0)).alias("classified_days"), F.coalesce("green", F.lit(0)).alias("green_days"), (F.greatest(F.datediff("last", "first"), F.lit(0)) + 1).cast("long").alias("span_days"),
    )
    t = t.withColumns({"value_ms": F.least(F.col("green_days") * DAY_MS, F.col("lead_ms")), "coverage": F.least(F.col("classified_days") / F.col("span_days"), F.lit(1.0))})
    return t.withColumn("confidence", F.when(F.col("coverage") < 0.2, "unclassified").when(F.col("coverage") < 0.8, "partial").otherwise("classified"))


def whiteboard(beds: DataFrame, held: DataFrame, flags: DataFrame, colours: DataFrame, today: str) -> DataFrame:
    """A card for each bed: stay, days, flags, colour, and a tag that changes with the content but not with the day it is read."""
    said = flags.groupBy("stay").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"))
    cards = beds.join(held, "bed", "left").join(said, "stay", "left").join(colours, "stay", "left")
    cards = cards.select("bed", "ward", "state", "stay", F.datediff(F.lit(today).cast("date"), F.to_date("admitted_at")).alias("days"), F.coalesce("flags", F.lit("")).alias("flags"), "colour")
    content = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("bed", "ward", "state", "stay", "flags", "colour")]
    return cards.withColumn("tag", F.sha2(F.concat_ws("\x1f", *content), 256))


def red_green_problems(classification: str, reasons: str, known: list[str]) -> Column:
    """All rules that a day breaks: its colour, two reasons at most, all of them known, and none on a green day."""
    c, r = F.col(classification), F.col(reasons)
    plain = F.array(F.when(~c.isin("red", "green"), F.lit("classification")), F.when(F.size(r) > 2, F.lit("too_many_reasons")), F.when((c == "green") & (F.size(r) > 0), F.lit("green_with_reasons")))
    return F.concat(F.array_compact(plain), F.transform(F.filter(r, lambda x: ~x.isin(known)), lambda x: F.lit("unknown_reason")))


def _counts(rows: DataFrame, key: str, by: str, name: str) -> DataFrame:
    counted = rows.groupBy(key, by).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", by, F.col("n").cast("string")))), ",").alias(name))


def cohort_rollup(instances: DataFrame, steps: DataFrame) -> DataFrame:
    """Of each pathway: instances, by_status and by_urgency as ``value:count`` lists, steps done and in all."""
    total = instances.groupBy("pathway").agg(F.count(F.lit(1)).alias("instances"))
    done = instances.select("instance", "pathway").join(steps, "instance").groupBy("pathway").agg(F.count_if("done").alias("steps_done"), F.count(F.lit(1)).alias("steps_total"))
    out = total.join(_counts(instances, "pathway", "status", "by_status"), "pathway").join(_counts(instances, "pathway", "urgency", "by_urgency"), "pathway").join(done, "pathway", "left")
    return out.fillna(0, ["steps_done", "steps_total"])


def screening_reach(instances: DataFrame, screens: DataFrame, threshold: float, within_days: int | None = None, floor: int = FLOOR) -> DataFrame:
    """Of each cohort: enrolled, screened, unscreened, positive, negative and reach, all withheld where one of the counts is small.

    What counts is the first screen of an instance, not before day 0 and not after ``within_days``.
    """
    first = screens.groupBy("instance").agg(F.min(F.struct("screened_on", "at", "score")).alias("s"))
    days = F.greatest(F.datediff("s.screened_on", "anchor"), F.lit(0))
    reached = F.col("s").isNotNull() & (F.lit(True) if within_days is None else days <= within_days)
    c = instances.join(first, "instance", "left").groupBy("cohort").agg(F.count(F.lit(1)).alias("enrolled"), F.count_if(reached).alias("screened"), F.count_if(reached & (F.col("s.score") >= threshold)).alias("positive"))
    c = c.withColumns({"unscreened": F.col("enrolled") - F.col("screened"), "negative": F.col("screened") - F.col("positive")})
    names = ["enrolled", "screened", "unscreened", "positive", "negative"]
    hidden = F.lit(False)
    for n in names:
        hidden = hidden | small(n, floor)
    c = c.withColumn("withheld", hidden).withColumn("reach", F.round(F.col("screened") / F.col("enrolled"), 9))
    return c.select("cohort", "withheld", *[F.when(~F.col("withheld"), F.col(n)).alias(n) for n in (*names, "reach")])


def valid_on(day: Column, since: str, until: str) -> Column:
    """Whether a day lies in a period whose end may be open."""
    return (F.col(since) <= day) & (F.col(until).isNull() | (F.col(until) >= day))
