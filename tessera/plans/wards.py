"""Wards, beds and stays, screening and cohorts, over records made from the driver's tables.

A supplier is a bed, an order a stay in the bed of its number, a line item a day of it that is
green or red, or a step of a pathway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evidence as E
from tessera.operators import relational as R
from tessera.operators import wards as W
from tessera.session import millis, table

#: 1998-03-01, the day on which boards are read.
TODAY = "1998-03-01"
AS_OF_MS = 888_710_400_000


def _beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS bed", "s_suppkey % 7 AS ward", "s_suppkey % 23 AS bay",
        "element_at(array('available', 'available', 'occupied', 'cleaning', 'available', 'closed'), CAST(s_suppkey % 6 AS INT) + 1) AS state",
        "s_suppkey % 7 != 5 AS ward_open", "s_suppkey % 7 = 3 AS ward_closed", "s_suppkey % 23 = 4 AS bay_closed", "element_at(array('female', 'male', 'mixed'), CAST(s_suppkey % 3 AS INT) + 1) AS bay_sex",
        "s_suppkey % 5 = 0 AS side_room", "s_suppkey % 10 = 1 AS isolation_capable", "s_suppkey % 2 = 0 AS oxygen", "s_suppkey % 9 = 0 AS bariatric", "s_nationkey % 4 AS specialty",
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "r_regionkey AS request", "r_regionkey % 2 = 0 AS need_isolation", "r_regionkey = 3 AS need_side_room", "r_regionkey = 2 AS need_oxygen", "FALSE AS need_bariatric",
        "element_at(array('male', 'female'), CAST(r_regionkey % 2 AS INT) + 1) AS sex", "r_regionkey + 1 AS target_ward", "r_regionkey % 4 AS wanted_specialty", "r_regionkey = 4 AS override_sex", "r_regionkey = 1 AS override_ward",
    )


def bed_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against each bed for each request, and the eligible ones in order: right ward first, side rooms saved."""
    pairs = _beds(spark, sf_dir).crossJoin(F.broadcast(_requests(spark, sf_dir)))  # five requests
    rows = pairs.withColumn("breaches", W.breaches())
    ranked = W.ranked_beds(rows.where(F.size("breaches") == 0))
    return rows.join(ranked.select("request", "bed", "rank"), ["request", "bed"], "left").select("request", "bed", F.array_join("breaches", ",").alias("breaches"), "rank")


def _stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("left_at"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    left = F.when((F.col("o_orderstatus") == "F") & (F.col("left_at") >= F.col("o_orderdate")), F.col("left_at"))
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("stay"), F.col("o_custkey").alias("patient"), F.col("o_orderdate").alias("admitted_at"), left.alias("discharged_at"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    return line.select(F.col("l_orderkey").alias("stay"), F.col("l_linenumber").alias("at"), F.to_date("l_shipdate").alias("day"), F.when(F.col("l_returnflag") == "R", "red").otherwise("green").alias("classification"))


def stay_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead time, green time, coverage and confidence of each stay."""
    return W.stay_timelines(_stays(spark, sf_dir), _days(spark, sf_dir), TODAY).withColumn("coverage", F.round("coverage", 9))


def delayed_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that open stays wait beyond the day they could have left, and overdue dates, unplanned ones first."""
    s = _stays(spark, sf_dir).where("discharged_at IS NULL AND stay % 8 < 5")
    s = s.select("stay", F.when(F.col("stay") % 8 > 0, F.date_add(F.to_date("admitted_at"), (F.col("stay") % 5).cast("int"))).alias("ready_on"), F.when(F.col("stay") % 8 < 4, F.date_add(F.to_date("admitted_at"), 10)).alias("expected_on"))
    today = F.lit(TODAY).cast("date")
    s = s.select("stay", F.greatest(F.coalesce(F.datediff(today, "ready_on"), F.lit(0)), F.lit(0)).alias("delay_days"), F.coalesce(F.col("expected_on") < today, F.lit(False)).alias("overdue"), F.col("expected_on").isNull().alias("unplanned"))
    return R.ranked(s, F.desc("unplanned"), F.desc("delay_days"), "stay", keys=("overdue",))


def whiteboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each bed of a ward: its latest open stay, flags, today's colour, and a tag of the content."""
    s = _stays(spark, sf_dir).where("discharged_at IS NULL")
    beds = _beds(spark, sf_dir).select("bed", "ward", "state")
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    held = R.latest(s.select((F.col("stay") % n + 1).alias("bed"), "stay", "admitted_at"), ["bed"], "admitted_at", "stay")
    flags = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("stay"), F.concat(F.lit("flag"), F.col("l_linenumber").cast("string")).alias("flag"))
    colours = _days(spark, sf_dir).groupBy("stay").agg(F.max_by("classification", F.struct("day", "at", "classification")).alias("colour"))
    return W.whiteboard(beds, held, flags, colours, TODAY)


def bed_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken as moves of beds, each allowed or not by the state machine."""
    e = table(spark, sf_dir, "events").select(F.col("event_id"), F.element_at(F.array(*map(F.lit, W.STATES)), (F.col("event_id") % len(W.STATES) + 1).cast("int")).alias("state"), F.element_at(F.array(*map(F.lit, W.MOVES)), (F.col("user_id") % len(W.MOVES) + 1).cast("int")).alias("move"), (F.col("event_id") % 3 == 0).alias("deep_clean"), (F.col("event_id") % 5 == 0).alias("virtual"), (F.col("event_id") % 7 == 0).alias("infectious"))
    return e.withColumn("next", W.next_state()).groupBy("state", "move").agg(F.count_if(F.col("next").isNull()).alias("refused"), F.min("next.state").alias("least_state"), F.count_if("next.deep_clean").alias("n_deep_clean"))


def status_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves between enrolment states that are allowed and not."""
    states = ["active", "on_hold", "completed", "discontinued"]
    e = table(spark, sf_dir, "events").select(*(F.element_at(F.array(*map(F.lit, states)), (F.col(k) % 4 + 1).cast("int")).alias(a) for k, a in (("event_id", "from_state"), ("user_id", "to_state"))))
    return R.check_moves(e, W.ENROLMENT).groupBy("from_state", "to_state", "valid").agg(F.count(F.lit(1)).alias("n"))


def red_green_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many days break which rule of a red or green day."""
    d = table(spark, sf_dir, "lineitem").select(F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("amber")), (F.col("l_linenumber") % 3 + 1)).alias("classification"), F.slice(F.array(F.lit("pharmacy"), F.lit("transport"), F.lit("weather")), F.lit(1), (F.col("l_orderkey") % 4).cast("int")).alias("reasons"))
    return d.select(F.explode(W.red_green_problems("classification", "reasons", ["pharmacy", "transport"])).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def cohort_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances by status and by urgency, and the steps done, for each kind of pathway."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"), (F.col("o_custkey") % 3).alias("pathway"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("urgency"))
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance"), (F.col("l_linestatus") == "F").alias("done"))
    return W.cohort_rollup(o, steps)


def screening_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reach of a screen within 30 days in each cohort, all figures withheld where one is small."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("instance"), F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 5).cast("string")).alias("cohort"), F.to_date("o_orderdate").alias("anchor"))
    screens = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("instance"), F.to_date("l_shipdate").alias("screened_on"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("at"))
    return W.screening_reach(o, screens, 40.0, 30)


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean percentile of the assessments that are valid on a day, its band, and missing ones last."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("worker"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity") * 2).alias("percentile"), F.to_date("l_shipdate").alias("since"), F.when(F.col("l_linenumber") % 2 == 0, F.date_add(F.to_date("l_shipdate"), 365)).alias("until"))
    valid = line.where(W.valid_on(F.lit(TODAY).cast("date"), "since", "until"))
    means = valid.groupBy("worker").agg(F.round(F.avg("percentile"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return R.ranked(means.withColumn("band", F.when(F.col("mean").isNotNull(), E.score_band(F.col("mean")))), F.col("mean").desc_nulls_last(), "worker")


QUERIES = {f.__name__: f for f in (bed_breaches, stay_timelines, delayed_transfers, whiteboard, bed_moves, status_moves, red_green_problems, cohort_rollup, screening_reach, assessments)}

_BEDS = """beds AS (SELECT s_suppkey AS bed, s_suppkey % 7 AS ward, s_suppkey % 23 AS bay, ['available', 'available', 'occupied', 'cleaning', 'available', 'closed'][CAST(s_suppkey % 6 AS INT) + 1] AS state, s_suppkey % 7 <> 5 AS ward_open,
    s_suppkey % 7 = 3 AS ward_closed, s_suppkey % 23 = 4 AS bay_closed, ['female', 'male', 'mixed'][CAST(s_suppkey % 3 AS INT) + 1] AS bay_sex, s_suppkey % 5 = 0 AS side_room, s_suppkey % 10 = 1 AS isolation_capable, s_suppkey % 2 = 0 AS oxygen,
    s_suppkey % 9 = 0 AS bariatric, s_nationkey % 4 AS specialty FROM supplier)"""
_STAYS = """st AS (SELECT o_orderkey AS stay, o_custkey AS patient, o_orderdate AS admitted_at, CASE WHEN o_orderstatus = 'F' AND left_at >= o_orderdate THEN left_at END AS discharged_at
    FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS left_at FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
_STATES = "[" + ", ".join(map(repr, W.STATES)) + "]"
_MOVES = "[" + ", ".join(map(repr, W.MOVES)) + "]"
_ROUTES = ", ".join(f"('{a}', '{m}', '{b}')" for (a, m), b in W.ROUTES.items())

ORACLE = {
    "bed_breaches": f"""
        WITH {_BEDS}, q AS (SELECT r_regionkey AS request, r_regionkey % 2 = 0 AS iso, r_regionkey = 3 AS side, r_regionkey = 2 AS oxy, ['male', 'female'][CAST(r_regionkey % 2 AS INT) + 1] AS sex, r_regionkey + 1 AS target, r_regionkey % 4 AS spec,
            r_regionkey = 4 AS o_sex, r_regionkey = 1 AS o_ward FROM region),
        b AS (SELECT request, bed, ward <> target AS other_ward, side_room AND NOT (side OR iso) AS waste, concat_ws(',', CASE WHEN state <> 'available' OR NOT ward_open OR ward_closed OR bay_closed THEN 'not_open' END,
            CASE WHEN NOT (side_room OR bay_sex = 'mixed' OR sex = bay_sex) AND NOT o_sex THEN 'sex_segregation' END, CASE WHEN (side AND NOT side_room) OR (iso AND NOT (side_room OR isolation_capable)) THEN 'isolation' END,
            CASE WHEN oxy AND NOT oxygen THEN 'equipment' END, CASE WHEN NOT (ward = target OR specialty = spec OR o_ward) THEN 'ward_fit' END) AS breaches FROM beds, q)
        SELECT request, bed, breaches, CASE WHEN breaches = '' THEN CAST(row_number() OVER (PARTITION BY request, breaches = '' ORDER BY other_ward, waste, bed) AS INTEGER) END AS rank FROM b""",
    "stay_timelines": f"""
        WITH {_STAYS}, d AS (SELECT l_orderkey AS stay, CAST(l_shipdate AS DATE) AS day, arg_min(CASE WHEN l_returnflag = 'R' THEN 'red' ELSE 'green' END, (l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'red' ELSE 'green' END)) AS c FROM lineitem GROUP BY 1, 2),
        e AS (SELECT *, greatest(coalesce(discharged_at, TIMESTAMP '{TODAY}'), admitted_at) AS stop, CAST(coalesce(discharged_at, TIMESTAMP '{TODAY}') AS DATE) AS last FROM st),
        n AS (SELECT e.stay, count(d.day) AS classified, count(*) FILTER (c = 'green') AS green FROM e LEFT JOIN d ON d.stay = e.stay AND d.day BETWEEN CAST(admitted_at AS DATE) AND last GROUP BY 1),
        t AS (SELECT e.stay, epoch_ms(stop) - epoch_ms(admitted_at) AS lead_ms, classified, green, greatest(last - CAST(admitted_at AS DATE), 0) + 1 AS span_days FROM e JOIN n USING (stay))
        SELECT stay, lead_ms, least(green * 86400000, lead_ms) AS value_ms, classified AS classified_days, green AS green_days, span_days, round(least(classified / span_days, 1.0), 9) AS coverage,
               CASE WHEN least(classified / span_days, 1.0) < 0.2 THEN 'unclassified' WHEN least(classified / span_days, 1.0) < 0.8 THEN 'partial' ELSE 'classified' END AS confidence FROM t""",
    "delayed_transfers": f"""
        WITH {_STAYS}, s AS (SELECT stay, CASE WHEN stay % 8 > 0 THEN CAST(admitted_at AS DATE) + CAST(stay % 5 AS INT) END AS ready, CASE WHEN stay % 8 < 4 THEN CAST(admitted_at AS DATE) + 10 END AS expected FROM st WHERE discharged_at IS NULL AND stay % 8 < 5),
        t AS (SELECT stay, CAST(greatest(coalesce(DATE '{TODAY}' - ready, 0), 0) AS INTEGER) AS delay_days, coalesce(expected < DATE '{TODAY}', FALSE) AS overdue, expected IS NULL AS unplanned FROM s)
        SELECT *, CAST(row_number() OVER (PARTITION BY overdue ORDER BY unplanned DESC, delay_days DESC, stay) AS INTEGER) AS rank FROM t""",
    "whiteboard": f"""
        WITH {_BEDS}, {_STAYS}, h AS (SELECT stay % (SELECT count(*) FROM supplier) + 1 AS bed, stay, admitted_at FROM st WHERE discharged_at IS NULL QUALIFY row_number() OVER (PARTITION BY stay % (SELECT count(*) FROM supplier) + 1 ORDER BY admitted_at DESC, stay DESC) = 1),
        f AS (SELECT l_orderkey AS stay, string_agg(DISTINCT 'flag' || l_linenumber, ',' ORDER BY 'flag' || l_linenumber) AS flags FROM lineitem WHERE l_quantity > 45 GROUP BY 1),
        c AS (SELECT stay, arg_max(c, (day, no, c)) AS colour FROM (SELECT l_orderkey AS stay, CAST(l_shipdate AS DATE) AS day, l_linenumber AS no, CASE WHEN l_returnflag = 'R' THEN 'red' ELSE 'green' END AS c FROM lineitem) GROUP BY 1),
        w AS (SELECT beds.bed, ward, state, h.stay, CAST(DATE '{TODAY}' - CAST(admitted_at AS DATE) AS INTEGER) AS days, coalesce(flags, '') AS flags, colour FROM beds LEFT JOIN h USING (bed) LEFT JOIN f ON f.stay = h.stay LEFT JOIN c ON c.stay = h.stay)
        SELECT *, sha256(concat_ws(chr(31), CAST(bed AS VARCHAR), CAST(ward AS VARCHAR), state, coalesce(CAST(stay AS VARCHAR), ''), flags, coalesce(colour, ''))) AS tag FROM w""",
    "bed_moves": f"""
        WITH e AS (SELECT {_STATES}[CAST(event_id % {len(W.STATES)} AS INT) + 1] AS state, {_MOVES}[CAST(user_id % {len(W.MOVES)} AS INT) + 1] AS move, event_id % 3 = 0 AS deep, event_id % 5 = 0 AS virt, event_id % 7 = 0 AS inf FROM events),
        r(state, move, nxt) AS (VALUES {_ROUTES}),
        n AS (SELECT e.*, CASE WHEN move = 'clean_complete' AND deep THEN NULL WHEN move = 'vacate' AND virt AND nxt IS NOT NULL THEN 'available' WHEN move = 'reopen' AND deep AND nxt IS NOT NULL THEN 'awaiting_clean' ELSE nxt END AS nx FROM e LEFT JOIN r USING (state, move))
        SELECT state, move, count(*) FILTER (nx IS NULL) AS refused, min(nx) AS least_state, count(*) FILTER (nx IS NOT NULL AND CASE move WHEN 'vacate' THEN NOT virt AND (deep OR inf) WHEN 'clean_complete' THEN FALSE ELSE deep END) AS n_deep_clean FROM n GROUP BY 1, 2""",
    "status_moves": """
        WITH e AS (SELECT ['active', 'on_hold', 'completed', 'discontinued'][CAST(event_id % 4 AS INT) + 1] AS from_state, ['active', 'on_hold', 'completed', 'discontinued'][CAST(user_id % 4 AS INT) + 1] AS to_state FROM events)
        SELECT from_state, to_state, from_state IN ('active', 'on_hold') AND from_state <> to_state AS valid, count(*) AS n FROM e GROUP BY ALL""",
    "red_green_problems": """
        WITH d AS (SELECT ['red', 'green', 'amber'][l_linenumber % 3 + 1] AS c, ['pharmacy', 'transport', 'weather'][1:CAST(l_orderkey % 4 AS INT)] AS r FROM lineitem),
        p AS (SELECT unnest(list_concat([CASE WHEN c = 'amber' THEN 'classification' END, CASE WHEN len(r) > 2 THEN 'too_many_reasons' END, CASE WHEN c = 'green' AND len(r) > 0 THEN 'green_with_reasons' END], ['unknown_reason' FOR x IN r IF x = 'weather'])) AS problem FROM d)
        SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1""",
    "cohort_rollup": """
        WITH o AS (SELECT o_orderkey AS i, o_custkey % 3 AS pathway, o_orderstatus AS s, o_orderpriority[1:1] AS u FROM orders), st AS (SELECT pathway, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS done FROM o JOIN lineitem ON i = l_orderkey GROUP BY 1),
        g AS (SELECT pathway, count(*) AS instances FROM o GROUP BY 1), a AS (SELECT pathway, string_agg(s || ':' || n, ',' ORDER BY s) AS by_status FROM (SELECT pathway, s, count(*) AS n FROM o GROUP BY ALL) GROUP BY 1),
        b AS (SELECT pathway, string_agg(u || ':' || n, ',' ORDER BY u) AS by_urgency FROM (SELECT pathway, u, count(*) AS n FROM o GROUP BY ALL) GROUP BY 1)
        SELECT pathway, instances, by_status, by_urgency, coalesce(done, 0) AS steps_done, coalesce(total, 0) AS steps_total FROM g JOIN a USING (pathway) JOIN b USING (pathway) LEFT JOIN st USING (pathway)""",
    "screening_reach": """
        WITH o AS (SELECT o_orderkey AS i, o_orderpriority || '/' || (o_custkey % 5) AS cohort, CAST(o_orderdate AS DATE) AS anchor FROM orders WHERE o_orderkey % 5 = 0),
        f AS (SELECT l_orderkey AS i, min({'d': CAST(l_shipdate AS DATE), 'n': l_linenumber, 'q': l_quantity}) AS x FROM lineitem WHERE l_quantity > 30 GROUP BY 1),
        w AS (SELECT cohort, CASE WHEN x IS NOT NULL THEN greatest(x.d - anchor, 0) END AS days, x.q AS score FROM o LEFT JOIN f USING (i)), c AS (SELECT cohort, count(*) AS enrolled, count(*) FILTER (days <= 30) AS screened, count(*) FILTER (days <= 30 AND score >= 40) AS positive FROM w GROUP BY 1),
        s AS (SELECT *, enrolled - screened AS unscreened, screened - positive AS negative FROM c), h AS (SELECT *, enrolled BETWEEN 1 AND 4 OR screened BETWEEN 1 AND 4 OR unscreened BETWEEN 1 AND 4 OR positive BETWEEN 1 AND 4 OR negative BETWEEN 1 AND 4 AS withheld FROM s)
        SELECT cohort, withheld, CASE WHEN NOT withheld THEN enrolled END AS enrolled, CASE WHEN NOT withheld THEN screened END AS screened, CASE WHEN NOT withheld THEN unscreened END AS unscreened, CASE WHEN NOT withheld THEN positive END AS positive,
               CASE WHEN NOT withheld THEN negative END AS negative, CASE WHEN NOT withheld THEN round(screened / enrolled, 9) END AS reach FROM h""",
    "assessments": f"""
        WITH a AS (SELECT l_suppkey AS worker, CASE WHEN l_linenumber < 6 THEN l_quantity * 2 END AS p, CAST(l_shipdate AS DATE) AS since, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE) + 365 END AS until FROM lineitem),
        m AS (SELECT worker, round(avg(p), 6) AS mean, count(*) AS n FROM a WHERE since <= DATE '{TODAY}' AND (until IS NULL OR until >= DATE '{TODAY}') GROUP BY 1)
        SELECT *, CASE WHEN mean >= 90 THEN 'Very High' WHEN mean >= 75 THEN 'High' WHEN mean >= 25 THEN 'Average' WHEN mean >= 10 THEN 'Low' WHEN mean IS NOT NULL THEN 'Very Low' END AS band,
               CAST(row_number() OVER (ORDER BY mean DESC NULLS LAST, worker) AS INTEGER) AS rank FROM m""",
}
