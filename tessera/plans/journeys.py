"""Journeys from the events table: a user's events are stages of one instance.

A segment starts at its event and lasts a tenth of its value in hours, at least a minute, so
some overlap and some leave gaps. The clock runs from the first start to the last end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import disclosure as D
from tessera.operators import intervals as I
from tessera.operators import rules as RL
from tessera.operators import variants as V
from tessera.session import materialize, millis, table

AS_OF_MS = 1_706_745_600_000  # 2024-02-01


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", "value")
    start = millis("ts")
    category = F.when(F.col("event_type") == "purchase", "VA").when(F.col("event_type").isin("signup", "click"), "NNVA").otherwise("UNVA")
    return e.select("user_id", "event_id", F.col("event_type").alias("stage"), category.alias("category"), start.alias("start_ms"), (start + F.greatest(F.lit(60_000), F.floor(F.col("value") * 360_000))).cast("long").alias("end_ms"))


def clocks(s: DataFrame) -> DataFrame:
    return s.groupBy("user_id").agg(F.min("start_ms").alias("t0"), F.max("end_ms").alias("t1"))


def interval_union_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the unions of a user's segments."""
    return I.gaps(segments(spark, sf_dir), "user_id")


def elapsed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead time split by value, touch time, ratios and coverage."""
    s = segments(spark, sf_dir)
    parts = I.elapsed_parts(s, clocks(s), "user_id")
    return parts.withColumn("confidence", I.confidence("coverage"))


def time_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of time by user and stage, summed over users (M5)."""
    s = segments(spark, sf_dir)
    return I.covered(s, "ms", "user_id", "stage").groupBy("stage").agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("instances"))


def process_map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directly-follows edges with pseudo-nodes."""
    return I.process_map(segments(spark, sf_dir), "user_id")


def stage_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First start of three stages and the days between them."""
    return I.anchors(segments(spark, sf_dir), "user_id", ["signup", "view", "purchase"])


def compliance_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose first purchase came within three days of their first signup (M8)."""
    a = I.anchors(segments(spark, sf_dir), "user_id", ["signup", "purchase"])
    return I.compliance(a, "signup_to_purchase", 3.0, 0.92)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as instances: opened at their date, closed with the last shipment unless still open."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    done = (F.col("o_orderstatus") != "O") & (F.col("shipped") >= F.col("o_orderdate"))
    rows = o.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", "o_orderpriority", done.alias("closed"), millis("o_orderdate").alias("t0"), F.when(done, millis("shipped")).alias("closed_ms"), F.when(done, F.datediff("shipped", "o_orderdate")).otherwise(F.datediff(F.lit("1999-01-01"), "o_orderdate")).alias("days")).where("days >= 0")


def kaplan_meier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival of orders until closed, by priority, open ones censored (M9)."""
    return I.kaplan_meier(_orders(spark, sf_dir), "days", "closed", "o_orderpriority")


def log_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders against all others."""
    return I.log_rank(_orders(spark, sf_dir), "days", "closed", "o_orderpriority", "1-URGENT")


def flow_little_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow of one quarter."""
    return I.little_law(_orders(spark, sf_dir), 852_076_800_000, 859_852_800_000)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus", "l_quantity")
    return line.select("l_orderkey", F.col("l_linenumber").alias("position"), F.when(F.col("l_quantity") < 45, F.col("l_shipdate")).alias("done_at")).groupBy("l_orderkey", "position").agg(F.min("done_at").alias("done_at"))


def step_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent lines of an order as declared steps, lines of 45 and more being undone."""
    return I.step_conformance(_steps(spark, sf_dir), "l_orderkey")


def step_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose done lines go back in time."""
    return I.out_of_order(_steps(spark, sf_dir), "l_orderkey")


def conformance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of fully conformant orders among those with a ratio."""
    c = I.step_conformance(_steps(spark, sf_dir), "l_orderkey")
    return c.agg(F.count("ratio").alias("with_ratio"), F.count_if(F.col("ratio") == 1).alias("n_full")).withColumn("share", F.when(F.col("with_ratio") > 0, F.round(F.col("n_full") / F.col("with_ratio"), 9)))


def journey_dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the eight data-quality codes over users."""
    from tessera.operators.rollups import closed_counts

    s = segments(spark, sf_dir)
    e = s.groupBy("user_id").agg(F.min("start_ms").alias("enrolled_ms"), F.max("start_ms").alias("last"), F.max_by("stage", F.struct("start_ms", "event_id")).alias("final"))
    inst = e.select("user_id", "enrolled_ms", F.when(F.col("final") == "purchase", "completed").otherwise("active").alias("status"), F.lit(None).cast("long").alias("clock_start_ms"), F.when(F.col("user_id") % 2 == 0, F.col("last")).alias("clock_stop_ms"), F.col("last").alias("closed_ms"))
    inst = I.clock(inst, AS_OF_MS)
    steps = s.select("user_id", F.col("event_id").alias("position"), F.col("start_ms").alias("done_at"))
    codes = I.dq_codes(inst, s, steps, "user_id", AS_OF_MS, ["completed"], 0.2, ("signup", "purchase"))
    return closed_counts(codes.select(F.explode("codes").alias("c")), "c", I.DQ_CODES)


def variants_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of stages by count."""
    found = V.variants(segments(spark, sf_dir), "user_id", AS_OF_MS, gap_days=0.5, window_days=0.02, most=3)
    return V.variant_table(found).withColumns({"share": F.round("share", 9), "cumulative": F.round("cumulative", 9)})


def rule_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a purchase and without an error against the rest, small sides withheld."""
    has = segments(spark, sf_dir).groupBy("user_id").agg(F.collect_set("stage").alias("stages"), F.count(F.lit(1)).alias("n"))
    match = RL.matches(["stage:purchase"], ["stage:error"], {"stage": {"signup", "view", "click", "purchase", "error"}})
    sides = has.groupBy(F.when(match, "matched").otherwise("complement").alias("side")).agg(F.count(F.lit(1)).alias("instances"))
    return sides.select("side", F.when(~D.small("instances"), F.col("instances")).alias("instances"), D.small("instances").alias("withheld"))


def attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users left after each rule in turn."""
    has = segments(spark, sf_dir).groupBy("user_id").agg(F.collect_set("stage").alias("stages"))
    rules = ["signup", "view", "click", "purchase"]
    tests = [F.forall(F.array(*[F.lit(r) for r in rules[: i]]), lambda r: F.array_contains("stages", r)) if i else F.lit(True) for i in range(len(rules) + 1)]
    one = has.agg(*[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests)])
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(rules[i - 1] if i else "all").alias("rule"), F.col(f"n{i}").alias("n")) for i in range(len(tests))])
    return one.select(F.inline(steps)).withColumn("parent", F.when(F.col("step") > 0, F.col("step") - 1))


def journey_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user: lead time, value and process ratios, handoffs, stages, and whether the journey is still open."""
    s = segments(spark, sf_dir)
    parts = I.elapsed_parts(s, clocks(s), "user_id").select("user_id", "lead_ms", "va_ratio", "pt_ratio")
    handed = I.gaps(s, "user_id").groupBy("user_id").agg(F.count_if("handoff").alias("handoffs"))
    shape = s.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"), (~F.bool_or(F.col("stage") == "purchase")).alias("censored"))
    return parts.join(shape, "user_id").join(handed, "user_id", "left").fillna(0, ["handoffs"])


def constraint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage that most of the waste lies in, and the handover that loses the most time."""
    s = segments(spark, sf_dir)
    waste = I.covered(s.where("category != 'VA'"), "ms", "user_id", "stage").groupBy("stage").agg(F.sum("ms").alias("ms"))
    return RL.findings(waste, I.gaps(s, "user_id"), 0.25)


def suppressed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation and segment, small cells and their complements withheld."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = c.groupBy("n_regionkey", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return D.withhold(D.suppress(cells, "n_regionkey", "n_name", "c_mktsegment", floor=8))


def suppressed_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary suppression alone."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return n.select("c_nationkey", "c_mktsegment", F.when(~D.small("n", 8), F.col("n")).alias("n"), D.small("n", 8).alias("withheld"))


def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names masked but for four characters."""
    return table(spark, sf_dir, "customer").select("c_custkey", D.mask("c_name").alias("masked"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a hash-chained log of each user; rows of every 83rd event are unchained."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 83 != 0).alias("kept"))
    return materialize(D.chain(e, "user_id", "event_id", ["event_id", "event_type"], "kept"), "journey-log").drop("kept")


def hash_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained logs in which some rows' content and some rows' links were changed afterwards, verified."""
    log = _log(spark, sf_dir)
    log = log.withColumns({
        "event_type": F.when(F.col("event_id") % 97 == 0, "changed").otherwise(F.col("event_type")),
        "prev_hash": F.when((F.col("event_id") % 89 == 0) & F.col("hash").isNotNull(), "broken").otherwise(F.col("prev_hash")),
    })
    return D.chain_summary(D.verify_chain(log, "user_id", "event_id", "event_id", "event_type"), "user_id", "event_id")


def chain_after_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs in which errors were erased still link; only the erased rows' content no longer fits."""
    log = D.erase(_log(spark, sf_dir), F.col("event_type") == "error", ["event_type"])
    v = D.verify_chain(log, "user_id", "event_id", "event_id", "event_type")
    return v.groupBy("user_id").agg(F.count_if("redacted").alias("n_redacted"), F.count_if(~F.col("linked")).alias("n_unlinked"), F.count_if(~F.col("intact") & ~F.col("redacted")).alias("n_changed"), F.count_if(~F.col("intact") & F.col("redacted")).alias("n_erased"))


def chain_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints taken at the third row of each log, held against the log after every seventh event was removed (P10)."""
    from pyspark.sql.window import Window

    log = _log(spark, sf_dir)
    third = log.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("n = 3").select("user_id", F.col("event_id").alias("seq"), F.col("hash").alias("head"), F.col("n").cast("long").alias("n"))
    return D.checkpoint_holds(log.where("event_id % 7 != 0"), "user_id", "event_id", third)


QUERIES = {f.__name__: f for f in (
    interval_union_gaps, elapsed_parts, time_by_stage, process_map_edges, stage_anchors, compliance_standard, kaplan_meier, log_rank, flow_little_law, step_conformance, step_out_of_order,
    conformance_share, journey_dq, variants_pareto, rule_split, attrition, suppressed_cells, suppressed_primary, masked_values, hash_chain_verify, chain_after_erasure, chain_checkpoints, journey_features, constraint_findings,
)}

_S = """s AS (SELECT user_id, event_id, event_type AS stage, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type IN ('signup', 'click') THEN 2 ELSE 3 END AS rank,
     (epoch_us(ts) // 1000) AS a, (epoch_us(ts) // 1000) + greatest(60000, CAST(floor(value * 360000) AS BIGINT)) AS b FROM events)"""


def _union(name: str, where: str, keys: str = "user_id") -> str:
    """SQL for the length of the union of segments by key."""
    return f"""{name} AS (SELECT {keys}, sum(e - st) AS ms FROM (
        SELECT {keys}, isl, min(a) AS st, max(b) AS e FROM (
            SELECT *, sum(o) OVER (PARTITION BY {keys} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM (
                SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY {keys} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM s WHERE {where}))
        GROUP BY {keys}, isl) GROUP BY {keys})"""


_O = """l AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
    o AS (SELECT *, coalesce(o_orderstatus <> 'O' AND shipped >= o_orderdate, false) AS closed FROM orders JOIN l ON o_orderkey = l_orderkey),
    r AS (SELECT o_orderkey, o_orderpriority, closed, (epoch_us(o_orderdate) // 1000) AS t0, CASE WHEN closed THEN (epoch_us(shipped) // 1000) END AS closed_ms,
          CASE WHEN closed THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(shipped AS DATE)) ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') END AS days FROM o)"""
_T = "t AS (SELECT l_orderkey, l_linenumber AS p, min(CASE WHEN l_quantity < 45 THEN l_shipdate END) AS d FROM lineitem GROUP BY ALL)"
_C = f"""WITH {_T}, n AS (SELECT *, lead(d) OVER w AS nd, lead(p) OVER w AS np FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY p)),
    c AS (SELECT l_orderkey, count(*) FILTER (WHERE d <= nd) AS in_order, count(*) FILTER (WHERE d > nd) AS inverted, count(*) FILTER (WHERE d IS NULL OR nd IS NULL) AS skipped FROM n WHERE np IS NOT NULL GROUP BY 1),
    f AS (SELECT *, round(in_order / (in_order + inverted + skipped), 9) AS ratio FROM c)"""

_LOG = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    c AS (SELECT user_id, n, event_id, event_type, CAST(NULL AS VARCHAR) AS prev, CASE WHEN event_id % 83 <> 0 THEN sha256(chr(31) || event_id || chr(31) || event_type) END AS hash FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.n, e.event_id, e.event_type, CASE WHEN e.event_id % 83 <> 0 THEN c.hash END, CASE WHEN e.event_id % 83 <> 0 THEN sha256(coalesce(c.hash, '') || chr(31) || e.event_id || chr(31) || e.event_type) END
          FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)"""

ORACLE = {
    "interval_union_gaps": f"""
        WITH {_S}, g AS (SELECT user_id, stage, a, max(b) OVER w AS f, arg_max(stage, (b, a, stage)) OVER w AS after_stage FROM s
            WINDOW w AS (PARTITION BY user_id ORDER BY a, b, stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT user_id, after_stage, stage, f AS from_ms, a AS to_ms, a - f AS gap_ms, after_stage <> stage AS handoff FROM g WHERE a > f""",
    "elapsed_parts": f"""
        WITH {_S}, {_union('v', 'rank = 1')}, {_union('p', 'rank <= 2')}, {_union('x', 'rank <= 3')},
        c AS (SELECT user_id, max(b) - min(a) AS lead_ms, coalesce(sum(b - a) FILTER (WHERE rank <= 2), 0) AS touch FROM s GROUP BY 1),
        j AS (SELECT user_id, lead_ms, coalesce(v.ms, 0) AS v, coalesce(p.ms, 0) AS p, coalesce(x.ms, 0) AS x, touch FROM c LEFT JOIN v USING (user_id) LEFT JOIN p USING (user_id) LEFT JOIN x USING (user_id))
        SELECT user_id, lead_ms, CAST(v AS BIGINT) AS va_ms, CAST(p - v AS BIGINT) AS nnva_ms, CAST(x - p AS BIGINT) AS unva_ms, CAST(lead_ms - x AS BIGINT) AS unrecorded_ms, CAST(touch AS BIGINT) AS touch_ms,
               round(v / lead_ms, 9) AS va_ratio, round(p / lead_ms, 9) AS pt_ratio, round(x / lead_ms, 9) AS coverage,
               CASE WHEN round(x / lead_ms, 9) < 0.2 THEN 'unmapped' WHEN round(x / lead_ms, 9) < 0.8 THEN 'partial' ELSE 'mapped' END AS confidence FROM j""",
    "time_by_stage": f"WITH {_S}, {_union('u', 'true', 'user_id, stage')} SELECT stage, CAST(sum(ms) AS BIGINT) AS ms, count(*) AS instances FROM u GROUP BY 1",
    "process_map_edges": f"""
        WITH {_S}, n AS (SELECT user_id, stage, b, lead(stage) OVER w AS nx, lead(a) OVER w AS na, lag(stage) OVER w AS pv FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, b, stage)),
        e AS (SELECT user_id, '(start)' AS f, stage AS t, CAST(NULL AS BIGINT) AS gap FROM n WHERE pv IS NULL UNION ALL SELECT user_id, stage, coalesce(nx, '(end)'), na - b FROM n)
        SELECT f AS from_stage, t AS to_stage, count(*) AS n, count(DISTINCT user_id) AS instances, round(avg(gap) / 86400000, 6) AS mean_gap_days FROM e GROUP BY 1, 2""",
    "stage_anchors": f"""
        WITH {_S}, f AS (SELECT user_id, min(a) FILTER (WHERE stage = 'signup') AS signup, min(a) FILTER (WHERE stage = 'view') AS view, min(a) FILTER (WHERE stage = 'purchase') AS purchase FROM s GROUP BY 1)
        SELECT *, CASE WHEN signup IS NOT NULL AND view IS NOT NULL THEN round(greatest(view - signup, 0) / 86400000, 6) END AS signup_to_view,
               CASE WHEN purchase IS NOT NULL AND view IS NOT NULL THEN round(greatest(purchase - view, 0) / 86400000, 6) END AS view_to_purchase FROM f""",
    "compliance_standard": f"""
        WITH {_S}, f AS (SELECT user_id, min(a) FILTER (WHERE stage = 'signup') AS x, min(a) FILTER (WHERE stage = 'purchase') AS y FROM s GROUP BY 1),
        d AS (SELECT CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN round(greatest(y - x, 0) / 86400000, 6) END AS days FROM f),
        c AS (SELECT count(*) FILTER (WHERE days <= 3) AS within, count(*) FILTER (WHERE days > 3) AS breached, count(*) FILTER (WHERE days IS NULL) AS unreached FROM d)
        SELECT *, round(within / (within + breached), 9) AS share, round(within / (within + breached), 9) >= 0.92 AS met FROM c""",
    "kaplan_meier": f"""
        WITH {_O}, g AS (SELECT o_orderpriority, days, count(*) AS n, count(*) FILTER (WHERE closed) AS events FROM r WHERE days >= 0 GROUP BY 1, 2),
        k AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM g),
        z AS (SELECT *, CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END AS lf FROM k),
        c AS (SELECT o_orderpriority, CAST(days AS INTEGER) AS days, CAST(at_risk AS BIGINT) AS at_risk, events,
               CASE WHEN bool_or(lf IS NULL) OVER w THEN 0.0 ELSE round(exp(sum(lf) OVER w), 9) END AS survival FROM z WINDOW w AS (PARTITION BY o_orderpriority ORDER BY days ROWS UNBOUNDED PRECEDING))
        SELECT * FROM c WHERE events > 0""",
    "log_rank": f"""
        WITH {_O}, g AS (SELECT days, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n1, count(*) FILTER (WHERE closed) AS d, count(*) FILTER (WHERE closed AND o_orderpriority = '1-URGENT') AS d1 FROM r WHERE days >= 0 GROUP BY 1),
        k AS (SELECT d, d1, sum(n) OVER w AS r, sum(n1) OVER w AS r1 FROM g WINDOW w AS (ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        t AS (SELECT CAST(sum(d1) AS BIGINT) AS observed, sum(d * r1 / r) AS e, sum(CASE WHEN r > 1 THEN d * r1 / r * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM k WHERE d > 0)
        SELECT observed, round(e, 6) AS expected, round(v, 6) AS variance, round(pow(observed - e, 2) / v, 6) AS chi2 FROM t""",
    "flow_little_law": f"""
        WITH {_O}, q AS (SELECT count(*) FILTER (WHERE t0 >= 852076800000 AND t0 < 859852800000) AS arrivals, count(*) FILTER (WHERE closed_ms >= 852076800000 AND closed_ms < 859852800000) AS closures,
            count(*) FILTER (WHERE t0 < 859852800000 AND (closed_ms IS NULL OR closed_ms >= 859852800000)) AS wip,
            quantile_disc((closed_ms - t0) / 86400000, 0.5) FILTER (WHERE closed_ms >= 852076800000 AND closed_ms < 859852800000) AS obs FROM r WHERE days >= 0),
        z AS (SELECT *, arrivals / 90 AS lam, closures / 90 AS mu, CASE WHEN arrivals > 0 THEN wip / (arrivals / 90) END AS implied FROM q)
        SELECT arrivals, closures, round(lam, 6) AS arrival_rate, round(mu, 6) AS service_rate, CASE WHEN mu > 0 THEN round(lam / mu, 6) END AS utilisation, wip, round(implied, 6) AS implied_days, round(obs, 6) AS observed_days,
               CASE WHEN implied IS NULL OR obs IS NULL THEN 'insufficient_data' WHEN implied < obs * 0.9 THEN 'queue_draining' WHEN implied > obs * 1.1 THEN 'queue_growing' ELSE 'steady' END AS interpretation FROM z""",
    "step_conformance": f"{_C} SELECT * FROM f",
    "step_out_of_order": f"WITH {_T}, n AS (SELECT l_orderkey, d, lag(d) OVER (PARTITION BY l_orderkey ORDER BY p) AS pd FROM t WHERE d IS NOT NULL) SELECT l_orderkey, bool_or(coalesce(d < pd, false)) AS out_of_order FROM n GROUP BY 1",
    "conformance_share": f"{_C} SELECT count(ratio) AS with_ratio, count(*) FILTER (WHERE ratio = 1) AS n_full, round(count(*) FILTER (WHERE ratio = 1) / count(ratio), 9) AS share FROM f",
    "rule_split": """
        WITH u AS (SELECT user_id, bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'error') AS m FROM events GROUP BY 1), g AS (SELECT CASE WHEN m THEN 'matched' ELSE 'complement' END AS side, count(*) AS n FROM u GROUP BY 1)
        SELECT side, CASE WHEN n >= 5 THEN n END AS instances, n < 5 AS withheld FROM g""",
    "attrition": """
        WITH u AS (SELECT list(DISTINCT event_type) AS s FROM events GROUP BY user_id), r(step, rule, need) AS (VALUES (0, 'all', []), (1, 'signup', ['signup']), (2, 'view', ['signup', 'view']), (3, 'click', ['signup', 'view', 'click']), (4, 'purchase', ['signup', 'view', 'click', 'purchase']))
        SELECT step, rule, count(*) FILTER (WHERE list_has_all(s, need)) AS n, CASE WHEN step > 0 THEN step - 1 END AS parent FROM r, u GROUP BY step, rule""",
    "suppressed_primary": """
        SELECT c_nationkey, c_mktsegment, CASE WHEN n >= 8 THEN n END AS n, n < 8 AS withheld FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)""",
    "masked_values": "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN c_name ELSE regexp_replace(left(c_name, length(c_name) - 4), '[\\p{L}\\p{N}]', '*', 'g') || right(c_name, 4) END AS masked FROM customer",
    "journey_dq": f"""
        WITH {_S}, c AS (SELECT user_id, min(a) AS t0, max(a) AS t1, arg_max(stage, (a, event_id)) AS final, bool_or(stage = 'signup') AND bool_or(stage = 'purchase') AS reached, max(b) AS far FROM s GROUP BY 1),
        k AS (SELECT user_id, s.a, least(s.b, t1) AS b FROM s JOIN c USING (user_id) WHERE least(s.b, t1) > s.a), {_union('u', 'true').replace('FROM s WHERE', 'FROM k WHERE')},
        o AS (SELECT user_id, bool_or(coalesce(a < pa, FALSE)) AS back FROM (SELECT user_id, a, lag(a) OVER (PARTITION BY user_id ORDER BY event_id) AS pa FROM s) GROUP BY 1),
        r AS (SELECT c.*, back, coalesce(ms, 0) AS ms FROM c JOIN o USING (user_id) LEFT JOIN u USING (user_id)),
        n AS (SELECT [('no_segments', count(*) FILTER (far IS NULL)), ('open_segment_past_closure', count(*) FILTER (far IS NULL AND final = 'purchase')), ('terminal_without_clock_stop', count(*) FILTER (final = 'purchase' AND user_id % 2 = 1)),
            ('step_done_before_enrolled', count(*) FILTER (t1 < t0)), ('steps_out_of_order', count(*) FILTER (back)), ('segment_clipped_by_clock', count(*) FILTER (far > t1)),
            ('coverage_below_floor', count(*) FILTER (t1 > t0 AND ms / (t1 - t0) < 0.2)), ('anchors_unreached', count(*) FILTER (NOT reached))] AS l FROM r)
        SELECT x[1] AS code, x[2] AS n FROM (SELECT unnest(l) AS x FROM n)""",
    "journey_features": f"""
        WITH {_S}, {_union('v', 'rank = 1')}, {_union('p', 'rank <= 2')},
        g AS (SELECT user_id, stage, a, max(b) OVER w AS f, arg_max(stage, (b, a, stage)) OVER w AS pv FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, b, stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        h AS (SELECT user_id, count(*) FILTER (a > f AND pv <> stage) AS handoffs FROM g GROUP BY 1),
        c AS (SELECT user_id, max(b) - min(a) AS lead_ms, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages, NOT bool_or(stage = 'purchase') AS censored FROM s GROUP BY 1)
        SELECT user_id, lead_ms, round(coalesce(v.ms, 0) / lead_ms, 9) AS va_ratio, round(coalesce(p.ms, 0) / lead_ms, 9) AS pt_ratio, stages, censored, handoffs FROM c JOIN h USING (user_id) LEFT JOIN v USING (user_id) LEFT JOIN p USING (user_id)""",
    "constraint_findings": f"""
        WITH {_S}, {_union('u', 'rank > 1', 'user_id, stage')}, w AS (SELECT stage, CAST(sum(ms) AS BIGINT) AS ms FROM u GROUP BY 1),
        g AS (SELECT stage, a, max(b) OVER k AS f, arg_max(stage, (b, a, stage)) OVER k AS pv FROM s WINDOW k AS (PARTITION BY user_id ORDER BY a, b, stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT pv || '>' || stage AS subject, CAST(sum(a - f) AS BIGINT) AS ms FROM g WHERE a > f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
        x AS (SELECT 'stage_dominates_waste' AS rule, stage AS subject, ms AS recoverable_ms FROM w WHERE ms > 0.25 * (SELECT sum(ms) FROM w) UNION ALL SELECT 'longest_gap', subject, ms FROM l)
        SELECT *, CAST(row_number() OVER (ORDER BY recoverable_ms DESC, rule, subject) AS INTEGER) AS rank FROM x""",
    "hash_chain_verify": f"""
        {_LOG}, t AS (SELECT user_id, n, event_id, hash, CASE WHEN event_id % 97 = 0 THEN 'changed' ELSE event_type END AS ty, CASE WHEN event_id % 89 = 0 AND hash IS NOT NULL THEN 'broken' ELSE prev END AS pv, lag(hash) OVER (PARTITION BY user_id ORDER BY n) AS lh FROM c),
        g AS (SELECT user_id, count(*) AS n_rows, count(hash) AS n_chained, count(*) FILTER (hash <> sha256(coalesce(pv, '') || chr(31) || event_id || chr(31) || ty)) AS n_changed, count(*) FILTER (hash IS NOT NULL AND pv IS DISTINCT FROM lh) AS n_unlinked,
              arg_max(hash, n) FILTER (hash IS NOT NULL) AS head FROM t GROUP BY 1) SELECT *, n_changed = 0 AND n_unlinked = 0 AS holds FROM g""",
    "chain_after_erasure": f"""
        {_LOG}, t AS (SELECT *, event_type = 'error' AS gone, lag(hash) OVER (PARTITION BY user_id ORDER BY n) AS lh FROM c)
        SELECT user_id, count(*) FILTER (gone) AS n_redacted, count(*) FILTER (hash IS NOT NULL AND prev IS DISTINCT FROM lh) AS n_unlinked, count(*) FILTER (NOT gone AND hash <> sha256(coalesce(prev, '') || chr(31) || event_id || chr(31) || event_type)) AS n_changed,
               count(*) FILTER (gone AND hash <> sha256(coalesce(prev, '') || chr(31) || event_id || chr(31) || '[erased]')) AS n_erased FROM t GROUP BY 1""",
    "chain_checkpoints": f"""
        {_LOG}, a AS (SELECT user_id, event_id AS seq, hash AS head FROM c WHERE n = 3), l AS (SELECT a.user_id, seq, head, count(*) AS m, max(hash) FILTER (event_id = seq) AS now FROM a JOIN c ON c.user_id = a.user_id AND event_id <= seq AND event_id % 7 <> 0 GROUP BY ALL)
        SELECT user_id, seq, now IS NOT DISTINCT FROM head AND m = 3 AS holds FROM l""",
}
