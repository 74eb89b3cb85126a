"""Operational rollups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.operators import rollups as A
from tessera.session import table

AS_OF = "1998-08-01"


def caseload_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group counts with conditional counts over a dimension join."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.count_if(F.col("o_orderstatus") == "O").alias("n_open"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
            F.countDistinct("o_custkey").alias("n_customers"),
        )
    )


def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))


def occupancy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of open orders of a nation over usable (not pending) ones, with the grand total."""
    per = _by_nation(spark, sf_dir).groupBy("n_name").agg(F.count_if(F.col("o_orderstatus") == "O").alias("occupied"), F.count_if(F.col("o_orderstatus") != "P").alias("usable"))
    total = per.agg(F.sum("occupied").alias("occupied"), F.sum("usable").alias("usable")).select(F.lit("(all)").alias("n_name"), "occupied", "usable")
    return per.unionByName(total).withColumns({"occupancy": A.guarded_share(F.col("occupied"), F.col("usable")), "available": F.greatest(F.col("usable") - F.col("occupied"), F.lit(0))})


def latest_order_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return R.latest(orders, ["o_custkey"], "o_orderdate", "o_orderkey")


def moves_last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the 24 hours before the last one, by type (A10)."""
    events = table(spark, sf_dir, "events").select("ts", "event_type", "user_id")
    now = events.agg(F.max("ts").alias("now"))
    recent = events.crossJoin(F.broadcast(now)).where((F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= F.col("now")))
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def cross_region_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose supplier and customer are in different regions."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    place = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("n_regionkey").alias("to_region"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("from_region"))
    moves = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return moves.where("from_region != to_region").groupBy("from_region", "to_region").agg(F.count(F.lit(1)).alias("n"))


def reconcile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders and customers without events, both ways."""
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return R.reconcile(ordered, seen, ["id"])


def condition_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by the segments their customers have: sets, singles and missing ones (A2-A4)."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    sets = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    return sets.select(
        "c_nationkey", F.array_join("segments", ",").alias("segments"), (F.size("segments") == 1).alias("only_one"),
        (~F.array_contains("segments", "BUILDING")).alias("no_building"), (~F.array_contains("segments", "MACHINERY")).alias("no_machinery"),
    )


def provider_by_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and sub-counts of a brand by type, and their rollup."""
    p = table(spark, sf_dir, "part").select("p_brand", F.substring_index("p_type", " ", 1).alias("kind"))
    return p.rollup("p_brand", "kind").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("p_brand", F.lit("(all)")).alias("p_brand"), F.coalesce("kind", F.lit("(all)")).alias("kind"), "n")


def care_team_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct open orders of each supplier and the flags it has."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    mine = line.join(open_, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return mine.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("open_orders"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("roles"))


def outcome_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status with the mean of each customer's latest total."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    last = R.latest(o, ["o_custkey", "o_orderstatus"], "o_orderdate", "o_orderkey")
    return last.groupBy(F.coalesce("o_orderstatus", F.lit("not_recorded")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_latest"))


def value_share_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each brand and the bits an agreement on it is worth."""
    return A.value_shares(table(spark, sf_dir, "part"), "p_brand", 100).select("value", "n", F.round("share", 9).alias("share"), F.round(A.share_bits(F.col("share")), 6).alias("bits"))


def dq_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a closed list of line states, zero ones kept."""
    line = table(spark, sf_dir, "lineitem").select("l_returnflag")
    return A.closed_counts(line, "l_returnflag", ["A", "N", "R", "X"])


def stage_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event type, the share of users without it and its entropy."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    users = e.agg(F.countDistinct("user_id").alias("users"))
    per = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("has")).crossJoin(F.broadcast(users))
    p = 1 - F.col("has") / F.col("users")
    return per.select("event_type", F.round(p, 9).alias("missing"), F.round(A.entropy(p), 9).alias("entropy"))


def lead_time_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the days from order to shipment, by priority."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    days = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", F.datediff("l_shipdate", "o_orderdate").cast("double").alias("days"))
    return days.groupBy("o_orderpriority").agg(*A.spread("days", "days"))


def type_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types by falling count with cumulative share."""
    n = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return A.pareto(n, "p_type", top=20).withColumns({"share": F.round("share", 9), "cumulative": F.round("cumulative", 9)})


def gauge_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest part types over a floor, and how many were left out."""
    n = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return A.gauges(n, "p_type", "n", cap=10, floor=3)


def orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of orders of every customer, zero included."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


def stalled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders whose last shipment is more than 60 days before the as-of day, unshipped ones first."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")
    all_ = o.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("last", A.last_activity("o_orderdate", "shipped"))
    idle = all_.select("o_orderkey", F.col("last.source").alias("source"), F.datediff(F.lit(AS_OF), F.col("last.at")).alias("idle_days"))
    return idle.where("idle_days > 60")


def folder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text filter over several fields, with optional equality filters."""
    p = R.optional_filter(table(spark, sf_dir, "part"), p_brand=None, p_size=list(range(1, 26)))
    return p.where(R.free_text(["p_name", "p_type", "p_brand"], "ST", ("p_name",))).select("p_partkey", "p_brand", "p_size")


def paged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of parts by size and key."""
    p = table(spark, sf_dir, "part").select("p_size", "p_partkey")
    return R.page(p, ["p_size", "p_partkey"], (3, 50), 40)


def merged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of this year's customer totals over all earlier ones."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    total = lambda df: df.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    cut = F.lit("1997-01-01").cast("timestamp")
    return R.upsert(total(o.where(F.col("o_orderdate") < cut)), total(o.where(F.col("o_orderdate") >= cut)), ["o_custkey"])


def segment_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of nations by the sets of brands their suppliers ship."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sets = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("s_nationkey").agg(F.collect_set("p_brand").alias("brands"))
    # Nations are 25 by definition of the table.
    other = sets.select(F.col("s_nationkey").alias("b"), F.col("brands").alias("theirs"))
    return sets.join(F.broadcast(other), F.col("s_nationkey") < F.col("b")).select(F.col("s_nationkey").alias("a"), "b", F.round(R.jaccard("brands", "theirs"), 9).alias("jaccard"))


QUERIES = {f.__name__: f for f in (
    caseload_by_segment, occupancy_ratio, latest_order_per_customer, moves_last_24h, cross_region_moves, reconcile_diff, condition_coverage_gaps, provider_by_setting, care_team_load,
    outcome_distribution, value_share_bits, dq_codes, stage_missingness, lead_time_percentiles, type_pareto, gauge_selection, orders_per_customer, stalled_orders, folder_search, paged_parts,
    merged_totals, segment_jaccard,
)}

_NATION = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
ORACLE = {
    "caseload_by_segment": """
        SELECT c_mktsegment, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
               count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent, count(DISTINCT o_custkey) AS n_customers
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "occupancy_ratio": f"""
        WITH per AS (SELECT n_name, count(*) FILTER (WHERE o_orderstatus = 'O') AS occupied, count(*) FILTER (WHERE o_orderstatus <> 'P') AS usable {_NATION} GROUP BY n_name),
        a AS (SELECT * FROM per UNION ALL SELECT '(all)', CAST(sum(occupied) AS BIGINT), CAST(sum(usable) AS BIGINT) FROM per)
        SELECT n_name, occupied, usable, CASE WHEN usable > 0 THEN round(occupied * 100.0 / usable, 1) ELSE 0.0 END AS occupancy, greatest(usable - occupied, 0) AS available FROM a""",
    "latest_order_per_customer": """
        SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "moves_last_24h": """
        WITH n AS (SELECT max(ts) AS now FROM events)
        SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events, n WHERE ts > now - INTERVAL 24 HOUR AND ts <= now GROUP BY event_type""",
    "cross_region_moves": """
        SELECT sn.n_regionkey AS from_region, cn.n_regionkey AS to_region, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey WHERE sn.n_regionkey <> cn.n_regionkey GROUP BY ALL""",
    "reconcile_diff": """
        SELECT DISTINCT o_custkey AS id, 'missing' AS side FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)
        UNION ALL SELECT DISTINCT user_id, 'extra' FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)""",
    "condition_coverage_gaps": """
        WITH s AS (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS x FROM customer GROUP BY c_nationkey)
        SELECT c_nationkey, array_to_string(x, ',') AS segments, len(x) = 1 AS only_one, NOT list_contains(x, 'BUILDING') AS no_building, NOT list_contains(x, 'MACHINERY') AS no_machinery FROM s""",
    "provider_by_setting": """
        SELECT coalesce(p_brand, '(all)') AS p_brand, coalesce(kind, '(all)') AS kind, n
        FROM (SELECT p_brand, kind, count(*) AS n FROM (SELECT p_brand, split_part(p_type, ' ', 1) AS kind FROM part) GROUP BY ROLLUP (p_brand, kind))""",
    "care_team_load": """
        SELECT l_suppkey, count(DISTINCT l_orderkey) AS open_orders, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS roles
        FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY l_suppkey""",
    "outcome_distribution": """
        WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
        SELECT coalesce(o_orderstatus, 'not_recorded') AS outcome, count(*) AS n, round(avg(o_totalprice), 2) AS mean_latest FROM l GROUP BY 1""",
    "value_share_bits": """
        WITH t AS (SELECT count(p_brand) AS total FROM part), c AS (SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1)
        SELECT value, n, round(n / total, 9) AS share, round(log2(0.95 / least(greatest(n / total, 1e-9), 0.95)), 6) AS bits FROM c, t WHERE total >= 100""",
    "dq_codes": """
        SELECT code, count(l_returnflag) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) v(code) LEFT JOIN lineitem ON l_returnflag = code GROUP BY code""",
    "stage_missingness": """
        WITH u AS (SELECT count(DISTINCT user_id) AS users FROM events), p AS (SELECT event_type, 1 - count(DISTINCT user_id) / any_value(users) AS p FROM events, u GROUP BY event_type)
        SELECT event_type, round(p, 9) AS missing, CASE WHEN p <= 0 OR p >= 1 THEN 0.0 ELSE round(-(p * log2(p) + (1 - p) * log2(1 - p)), 9) END AS entropy FROM p""",
    "lead_time_percentiles": """
        WITH d AS (SELECT o_orderpriority, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT o_orderpriority, min(days) AS days_min, quantile_disc(days, 0.5) AS days_p50, quantile_disc(days, 0.75) AS days_p75, quantile_disc(days, 0.9) AS days_p90,
               quantile_disc(days, 0.95) AS days_p95, max(days) AS days_max FROM d GROUP BY 1""",
    "type_pareto": """
        WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 20)
        SELECT p_type, n, CAST(row_number() OVER (ORDER BY n DESC, p_type) AS INTEGER) AS rank, round(n / sum(n) OVER (), 9) AS share,
               round(sum(n) OVER (ORDER BY n DESC, p_type ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS cumulative FROM c""",
    "gauge_selection": """
        WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), s AS (SELECT count(*) FILTER (WHERE n < 3) AS withheld, greatest(count(*) FILTER (WHERE n >= 3) - 10, 0) AS dropped FROM c)
        SELECT * FROM (SELECT * FROM c WHERE n >= 3 ORDER BY n DESC, p_type LIMIT 10), s""",
    "orders_per_customer": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "stalled_orders": f"""
        WITH s AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
        a AS (SELECT o_orderkey, CASE WHEN shipped > o_orderdate THEN 'shipped' ELSE 'o_orderdate' END AS source, greatest(o_orderdate, shipped) AS at_ FROM orders LEFT JOIN s ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O')
        SELECT o_orderkey, source, CAST(date_diff('day', CAST(at_ AS DATE), DATE '{AS_OF}') AS INTEGER) AS idle_days FROM a WHERE date_diff('day', CAST(at_ AS DATE), DATE '{AS_OF}') > 60""",
    "folder_search": """
        SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 1 AND 25
        AND (contains(replace(lower(p_name), ' ', ''), 'st') OR contains(lower(p_type), 'st') OR contains(lower(p_brand), 'st'))""",
    "paged_parts": "SELECT p_size, p_partkey FROM part WHERE p_size > 3 OR (p_size = 3 AND p_partkey > 50) ORDER BY 1, 2 LIMIT 40",
    "merged_totals": """
        WITH a AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
        b AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
        SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(b.t, a.t) AS total FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""",
    "segment_jaccard": """
        WITH s AS (SELECT s_nationkey AS k, list(DISTINCT p_brand) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))), 9) AS jaccard FROM s a JOIN s b ON a.k < b.k""",
}
