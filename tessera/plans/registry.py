"""What services around entity records do: filters, keys, search fields, consent, tamper evidence, outbox, journeys, over records made from the driver's tables."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import normalize as N
from tessera.functions import similarity as S
from tessera.operators import disclosure as D
from tessera.operators import graph as G
from tessera.operators import relational as R
from tessera.operators import rollups as RU
from tessera.operators import search as Q
from tessera.session import millis, table
from tessera.sources import bulk
from tessera.streaming import events as ST

KEY = b"an example key of a test"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records with identifiers, addresses and marks of deletion."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS pid", "c_name AS name", "c_mktsegment AS segment", "c_nationkey AS nation",
        "array_compact(array(CASE WHEN c_custkey % 3 = 0 THEN named_struct('identifier_type', 'SSN', 'system', 'us', 'value', concat('S', CAST(c_custkey DIV 9 AS STRING))) END, CASE WHEN c_custkey % 2 = 0 THEN named_struct('identifier_type', 'NPI', 'system', 'npi', 'value', concat('N', CAST(c_custkey DIV 4 AS STRING))) END)) AS identifiers",
        "CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 5 < 3 THEN concat('T', CAST(c_custkey AS STRING)) END AS tax_id",
        "array(named_struct('city', lower(c_mktsegment), 'postcode', concat('P', CAST(c_custkey % 13 AS STRING)))) AS addresses",
        "CASE WHEN c_custkey % 7 = 0 THEN DATE'2020-01-01' END AS deleted_at", "c_custkey % 4 != 1 AS active", "c_custkey % 6 = 0 AS sensitive",
    )


def token_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live records by ``system|value``, by a bare value, and by a part of an address."""
    r = R.live(_records(spark, sf_dir))
    tests = {"scoped": R.token_filter("identifiers", "us|S1"), "other_system": R.token_filter("identifiers", "npi|S1"), "bare": R.token_filter("identifiers", "N1"), "address": R.any_part("addresses", "BUILD", ("city", "postcode"))}
    return r.select("pid", *(t.alias(k) for k, t in tests.items())).where("scoped OR other_system OR bare OR address")


def json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose JSON has a value at a path (F8)."""
    e = table(spark, sf_dir, "events").where(R.json_equals("props", "$.k", "7"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive records for those who may see them alone, masked where only so allowed."""
    r = _records(spark, sf_dir).select("pid", "name", "sensitive", "nation")
    return R.visible(r, F.col("sensitive"), F.col("nation") % 3 == 0, F.col("nation") % 3 == 1, {"name": D.mask("name")}).select("pid", "name")


def primary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation with its first supplier, or none."""
    s = R.first_of(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey", "s_suppkey", "s_name"), ["s_nationkey"], "s_suppkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "s_suppkey", "s_name")


def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest key of each record, and whether it has none of its own."""
    key = bulk.stable_key("identifiers", "tax_id", "pid")
    return _records(spark, sf_dir).select("pid", key.alias("key"), key.startswith("PID:").alias("keyless"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each submission key, the earliest; jobs without a key all stay."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS job_id", "'person' AS entity", "event_type AS kind", "CASE WHEN event_id % 4 > 0 THEN CAST(user_id AS STRING) END AS idempotency_key", "ts AS submitted_at")
    return bulk.first_submissions(e).groupBy("kind").agg(F.count(F.lit(1)).alias("n_jobs"), F.sum("job_id").alias("sum_ids"))


def resource_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records found by type, name and city, as resources of a bundle."""
    r = R.live(_records(spark, sf_dir)).where(R.contains_ci("name", "r#0000000") & R.any_part("addresses", "auto", ("city",)))
    return r.select("pid", bulk.resource("Patient", id=F.col("pid").cast("string"), name=F.col("name"), city=F.get("addresses", F.lit(0))["city"]).alias("resource"))


def address_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, phones, course codes and case numbers in their normal forms."""
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS pid", "concat(' ', CAST(c_custkey AS STRING), element_at(array(' Main St.', ' Oak Ave. 2', ' Hill Rd ', ' Mill Ln.', ' Bay St x'), CAST(c_custkey % 5 AS INT) + 1)) AS line", "concat(' ', c_mktsegment, '  town') AS city",
        "element_at(array('(555) 010-', '+44 20 ', '1 555 010 ', 'x', '020 '), CAST(c_custkey % 5 AS INT) + 1) AS head", "concat('ab ', CAST(c_custkey AS STRING), '-c/', 'd') AS code",
    ).withColumn("phone", F.expr("CASE WHEN head = 'x' THEN 'none' ELSE concat(head, lpad(CAST(pid AS STRING), 4, '0')) END"))
    return c.select("pid", N.street_line("line").alias("line"), N.title_case("city").alias("city"), N.phone("phone").alias("phone"), N.course_code("code").alias("course"), N.case_number("code").alias("case_no"), F.array_join(N.fold_set(F.array("city", "code", "city")), "|").alias("folded"))


def well_formed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many made-up values have each form."""
    c = table(spark, sf_dir, "orders").selectExpr(
        "concat(lpad(CAST(o_orderkey % 2100 AS STRING), 4, '0'), '-', lpad(CAST(o_orderkey % 14 AS STRING), 2, '0'), '-', lpad(CAST(o_custkey % 32 AS STRING), 2, '0')) AS date", "concat(lpad(CAST(o_orderkey % 27 AS STRING), 2, '0'), ':', CAST(o_custkey % 70 AS STRING)) AS time",
        "concat(substr('AB1z', CAST(o_orderkey % 4 AS INT) + 1, 1), '0', CAST(o_custkey % 10 AS STRING), CASE WHEN o_custkey % 3 = 0 THEN '.1' ELSE '' END) AS icd10", "substr('GBuSx9', CAST(o_orderkey % 5 AS INT) + 1, 2) AS country",
    )
    return c.agg(*(F.count_if(N.well_formed(k, k)).alias(k) for k in ("date", "time", "icd10", "country")))


def time_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the next event of a user is, halved with each hour; ISO texts read as seconds."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", N.unix_seconds(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("at"))
    gap = F.lead("at").over(Window.partitionBy("user_id").orderBy("event_id")) - F.col("at")
    return e.withColumn("gap", gap).where("gap IS NOT NULL").select("event_id", F.round(S.half_life(F.col("gap")), 9).alias("near"))


def last_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of four sources against enrolment, the earlier-named on ties."""
    e = table(spark, sf_dir, "events").withColumn("at", millis("ts"))
    kinds = ["signup", "view", "click", "purchase", "error"]
    u = e.groupBy("user_id").agg(*(F.max(F.when(F.col("event_type") == k, F.floor(F.col("at") / 86_400_000))).alias(k) for k in kinds))
    return u.withColumn("last", RU.last_activity(*kinds)).select("user_id", "last.source", "last.at")


def merged_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A main record's list with what its duplicate adds."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "array(CAST(c_custkey % 4 AS STRING), c_mktsegment, CAST(c_custkey % 3 AS STRING)) AS tags")
    other = c.select((F.col("k") - 1).alias("k"), F.col("tags").alias("more"))
    return c.where("k % 2 = 0").join(other, "k", "left").select("k", F.array_join(R.list_union("tags", "more"), ",").alias("tags"))


def busy_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with customers of more than 20 nations, and nations with one segment's customers alone (A3)."""
    c = table(spark, sf_dir, "customer")
    many = c.groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("n")).where("n > 20").select(F.lit("many").alias("rule"), F.col("c_mktsegment").alias("of"), "n")
    return many.unionByName(c.where("c_acctbal > 9500").groupBy("c_nationkey").agg(F.countDistinct("c_mktsegment").alias("n")).where("n = 1").select(F.lit("one").alias("rule"), F.col("c_nationkey").cast("string").alias("of"), "n"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_type AS kind", "1950 + p_size AS year", "date_add(DATE'2024-01-01', CAST(p_size AS INT)) AS held_on", "p_partkey % 5 = 0 AS masked")


def _by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.postings(_titles(spark, sf_dir), "id", ["name"])


def name_and_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold all words, those of the year first."""
    return Q.boosted(_by_name(spark, sf_dir), "small widget", _titles(spark, sf_dir).select("id", (F.col("year") == 1960).alias("boost")), "id", 1.0).select("id", F.round("score", 6).alias("score"))


def name_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a word, on days of a range with either end open."""
    t = _titles(spark, sf_dir)
    found = Q.matches(_by_name(spark, sf_dir), "+widget", "id")
    early = Q.date_range(t, "held_on", until="2024-01-10").select("id", F.lit("until").alias("range"))
    late = Q.date_range(t, "held_on", since="2024-02-01", until="2024-02-10").select("id", F.lit("between").alias("range"))
    return early.unionByName(late).join(found.select("id"), "id", "left_semi")


def masked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words found in fields that masking leaves alone."""
    t = _titles(spark, sf_dir)
    index = Q.postings(t, "id", ["name", "kind"])
    return Q.unmasked_matches(index, t.where("masked").select("id"), ["kind"], "economy widget", "id").select("id")


def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after documents changed and went, and its size."""
    t = _titles(spark, sf_dir)
    changed = Q.postings(t.where("id % 10 = 1").withColumn("name", F.concat("name", F.lit(" renewed"))), "id", ["name"])
    return Q.stats(Q.reindex(_by_name(spark, sf_dir), changed, t.where("id % 10 = 2").select("id"), "id"), "id")


def consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a consent that is active and hasn't run out."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pid"), F.struct(F.when(F.col("o_orderstatus") == "F", "active").otherwise("revoked").alias("status"), F.when(F.col("o_orderkey") % 3 > 0, F.to_date("o_orderdate")).alias("expires_on")).alias("c"))
    r = o.groupBy("pid").agg(F.collect_list("c").alias("consents"))
    return r.where(D.active_consent("consents", F.lit("1997-06-01").cast("date"))).select("pid")


def keyed_macs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed digests of names, and salted commitments of their segments."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", D.keyed_mac("c_name", KEY, "name").alias("mac"), D.commitment(F.col("c_custkey").cast("string"), F.col("c_mktsegment")).alias("commitment"))


def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose digest, over their canonical JSON, no longer fits."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    kept = s.select("s_suppkey", D.record_digest(s, "s_name", "s_nationkey", "s_suppkey").alias("digest"))
    now = s.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 11 == 0, F.lit(99)).otherwise(F.col("s_nationkey")))
    return now.join(kept, "s_suppkey").where(D.record_digest(now, "s_name", "s_nationkey", "s_suppkey") != F.col("digest")).select("s_suppkey")


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To whom a record's data went, in a period."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.when(F.col("event_type") == "view", "disclosed").otherwise("changed").alias("action"), (F.col("event_id") % 4).alias("recipient"), "ts")
    return D.disclosures(e, "2024-01-02", "2024-01-20").groupBy("entity_id", "recipient").agg(F.count(F.lit(1)).alias("n"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each user that a limit of three a day lets through."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (millis("ts") / 1000).cast("long").alias("at"))
    return D.rate_limited(e, "user_id", "at", "event_id", 3, 86_400).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outbox drained up to the first failure, then purged; its freshness by topic."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("pid"), F.col("event_type").alias("topic"), "ts", F.when(F.col("event_id") % 4 == 0, F.col("ts")).cast("timestamp").alias("published_at"))
    sent = ST.drain(e, lambda todo: todo.select("id", (F.col("id") % 499 != 498).alias("ok")), "2024-03-01 00:00:00")
    left = ST.purge(sent, "2024-01-03 00:00:00")
    fresh = ST.freshness(left.where("published_at IS NOT NULL").select("topic", F.col("ts").alias("occurred_at"), F.col("id").alias("offset")))
    n = left.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("published_at").isNull()).alias("n_waiting"))
    return n.join(fresh.select("topic", millis("watermark").alias("watermark_ms"), "offset"), "topic", "left")


def urn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References parsed, and the kinds of their edges with inverse and sensitivity."""
    s = table(spark, sf_dir, "supplier").selectExpr("concat(element_at(array('place:', 'Place:', 'person:', 'person'), CAST(s_suppkey % 4 AS INT) + 1), CAST(s_suppkey AS STRING)) AS ref", "element_at(array('located_in', 'employs', 'knows'), CAST(s_suppkey % 3 AS INT) + 1) AS kind")
    return G.with_kinds(s, [("located_in", "location_of", False, False), ("employs", "employed_by", True, True)]).select("ref", G.urn("ref")["type"].alias("type"), G.urn("ref")["id"].alias("id"), "kind", "inverse", "sensitive")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys of legs, each naming the next, walked to 16 legs and stitched."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("leg"), F.when(F.col("o_orderkey") % 5 < 4, F.when(F.col("o_orderkey") % 50 == 13, F.col("o_orderkey") - 3).otherwise(F.col("o_orderkey") + 1)).alias("next"), (F.col("o_orderkey") % 7 != 3).alias("resolved"), millis("o_orderdate").alias("t0"))
    o = o.withColumns({"t1": F.col("t0") + F.col("leg") % 9 * 1000, "lead_ms": F.col("leg") % 9 * 1000})
    walked = G.chain_walk(o.select("leg", "next"), o.where("leg % 5 = 0").select("leg"), 16)
    return G.stitch(walked.join(o.drop("next"), "leg"), "start")


def graph_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored graph against its source: what is missing, extra or of types that its kind forbids."""
    want = table(spark, sf_dir, "supplier").selectExpr("concat(CASE WHEN s_suppkey % 9 = 0 THEN 'part:' ELSE 'supplier:' END, s_suppkey) AS from_ref", "concat('nation:', s_nationkey) AS to_ref", "'in' AS kind")
    have = table(spark, sf_dir, "supplier").where("s_suppkey % 4 != 0").selectExpr("concat('supplier:', s_suppkey) AS from_ref", "concat('nation:', s_nationkey + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END) AS to_ref", "'in' AS kind")
    return G.reconcile_edges(have, want, [("in", "supplier", "nation")])


QUERIES = {f.__name__: f for f in (
    token_filters, json_filter, visible_rows, primary_names, stable_keys, submissions, resource_search, address_forms, well_formed_ids, time_similarity, last_activity, merged_tags, busy_nations, name_and_year, name_and_dates, masked_search,
    reindexed, consents, keyed_macs, record_digests, disclosures, attempts, outbox, urn_parts, chains, graph_reconciled,
)}

_OWN = hmac.new(hmac.new(bytes(32), KEY, "sha256").digest(), b"name\x01", "sha256").digest().ljust(64, b"\0")
_PADS = [bytes(b ^ p for b in _OWN).hex() for p in (0x36, 0x5C)]
assert len(hashlib.sha256().digest()) == 32
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_REC = """rec AS (SELECT c_custkey AS pid, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN 'S' || (c_custkey // 9) END AS ssn, CASE WHEN c_custkey % 2 = 0 THEN 'N' || (c_custkey // 4) END AS npi,
    CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 5 < 3 THEN 'T' || c_custkey END AS tax, c_custkey % 7 <> 0 AND c_custkey % 4 <> 1 AS live FROM customer)"""
_TITLES = "tt AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, 1950 + p_size AS year, DATE '2024-01-01' + p_size AS held_on, p_partkey % 5 = 0 AS masked FROM part)"
_MASK = "CASE WHEN length({0}) <= 4 THEN {0} ELSE regexp_replace(left({0}, length({0}) - 4), '[\\p{{L}}\\p{{N}}]', '*', 'g') || right({0}, 4) END"

ORACLE = {
    "token_filters": f"""
        WITH {_REC}, t AS (SELECT pid, coalesce(ssn = 'S1', FALSE) AS scoped, FALSE AS other_system, coalesce(npi = 'N1', FALSE) AS bare, contains(lower(segment), 'build') AS address FROM rec WHERE live) SELECT * FROM t WHERE scoped OR other_system OR bare OR address""",
    "json_filter": "SELECT event_type, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') = '7' GROUP BY 1",
    "visible_rows": f"SELECT c_custkey AS pid, CASE WHEN c_custkey % 6 = 0 AND c_nationkey % 3 = 1 THEN {_MASK.format('c_name')} ELSE c_name END AS name FROM customer WHERE c_custkey % 6 <> 0 OR c_nationkey % 3 < 2",
    "primary_names": "SELECT n_nationkey, s_suppkey, s_name FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1) ON n_nationkey = s_nationkey",
    "stable_keys": f"WITH {_REC} SELECT pid, coalesce('SSN:' || ssn, 'NPI:' || npi, 'TAX:' || nullif(trim(tax), ''), 'PID:' || pid) AS key, ssn IS NULL AND npi IS NULL AND nullif(trim(tax), '') IS NULL AS keyless FROM rec",
    "submissions": """
        WITH j AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, event_id % 4 > 0 ORDER BY ts, event_id) AS n FROM events)
        SELECT event_type AS kind, count(*) AS n_jobs, CAST(sum(event_id) AS BIGINT) AS sum_ids FROM j WHERE n = 1 OR event_id % 4 = 0 GROUP BY 1""",
    "resource_search": f"""
        WITH {_REC} SELECT pid, '{{"resourceType":"Patient","id":"' || pid || '","name":"' || name || '","city":"' || lower(segment) || '"}}' AS resource FROM rec WHERE live AND contains(lower(name), 'r#0000000') AND contains(lower(segment), 'auto')""",
    "address_forms": """
        WITH c AS (SELECT c_custkey AS pid, trim(' ' || c_custkey || [' Main St.', ' Oak Ave. 2', ' Hill Rd ', ' Mill Ln.', ' Bay St x'][CAST(c_custkey % 5 AS INT) + 1]) AS line, c_mktsegment AS m, 'ab ' || c_custkey || '-c/d' AS code,
            CASE WHEN c_custkey % 5 = 3 THEN '' ELSE regexp_replace(['(555) 010-', '+44 20 ', '1 555 010 ', '', '020 '][CAST(c_custkey % 5 AS INT) + 1] || lpad(CAST(c_custkey AS VARCHAR), 4, '0'), '[^0-9]', '', 'g') END AS d FROM customer)
        SELECT pid, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(line, 'St.', 'Street'), 'St ', 'Street '), 'Ave.', 'Avenue'), 'Ave ', 'Avenue '), 'Rd.', 'Road'), 'Rd ', 'Road '), 'Dr.', 'Drive'), 'Blvd.', 'Boulevard'), 'Ln.', 'Lane'), 'Ct.', 'Court') AS line,
               upper(m[1:1]) || lower(m[2:]) || ' Town' AS city, CASE WHEN d = '' THEN '' WHEN length(d) >= 10 AND starts_with(d, '1') THEN '+' || d WHEN length(d) <> 10 AND pid % 5 = 1 THEN '+' || d ELSE '+1' || d END AS phone,
               upper(replace(code, ' ', '')) AS course, 'AB' || pid || 'CD' AS case_no, array_to_string(list_sort([code, lower(m) || '  town']), '|') AS folded FROM c""",
    "well_formed_ids": """
        WITH c AS (SELECT lpad(CAST(o_orderkey % 2100 AS VARCHAR), 4, '0') || '-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_custkey % 32 AS VARCHAR), 2, '0') AS d, lpad(CAST(o_orderkey % 27 AS VARCHAR), 2, '0') || ':' || (o_custkey % 70) AS t,
            substr('AB1z', CAST(o_orderkey % 4 AS INT) + 1, 1) || '0' || (o_custkey % 10) || CASE WHEN o_custkey % 3 = 0 THEN '.1' ELSE '' END AS i, substr('GBuSx9', CAST(o_orderkey % 5 AS INT) + 1, 2) AS c FROM orders)
        SELECT count(*) FILTER (try_strptime(d, '%Y-%m-%d') IS NOT NULL AND d >= '0001') AS date, count(*) FILTER (regexp_full_match(t, '([01][0-9]|2[0-3]):[0-5][0-9]')) AS time, count(*) FILTER (regexp_full_match(i, '[A-Z][0-9][0-9A-Z](\\.[0-9A-Z]{1,4})?')) AS icd10,
               count(*) FILTER (regexp_full_match(c, '[A-Z]{2}')) AS country FROM c""",
    "time_similarity": """
        WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS a, lead(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT event_id, round(pow(2.0, -abs(b - a) / 3600.0), 9) AS near FROM e WHERE b IS NOT NULL""",
    "last_activity": """
        WITH u AS (SELECT user_id, """ + ", ".join(f"max(epoch_us(ts) // 86400000000) FILTER (event_type = '{k}') AS {k}_at" for k in ("signup", "view", "click", "purchase", "error")) + """ FROM events GROUP BY 1),
        g AS (SELECT *, greatest(signup_at, view_at, click_at, purchase_at, error_at) AS m FROM u)
        SELECT user_id, CASE m WHEN signup_at THEN 'signup' WHEN view_at THEN 'view' WHEN click_at THEN 'click' WHEN purchase_at THEN 'purchase' ELSE 'error' END AS source, m AS "at" FROM g""",
    "merged_tags": """
        WITH c AS (SELECT c_custkey AS k, [CAST(c_custkey % 4 AS VARCHAR), c_mktsegment, CAST(c_custkey % 3 AS VARCHAR)] AS t FROM customer), u AS (SELECT x.k, list_concat(x.t, coalesce(y.t, [])) AS l FROM c x LEFT JOIN c y ON y.k = x.k + 1 WHERE x.k % 2 = 0)
        SELECT k, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i], ',') AS tags FROM u""",
    "busy_nations": """
        SELECT 'many' AS rule, c_mktsegment AS of, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 2 HAVING count(DISTINCT c_nationkey) > 20
        UNION ALL SELECT 'one', CAST(c_nationkey AS VARCHAR), count(DISTINCT c_mktsegment) FROM customer WHERE c_acctbal > 9500 GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) = 1""",
    "name_and_year": f"""
        WITH {_TITLES}, k AS (SELECT id, unnest({_TOKENS.format('name')}) AS t FROM tt), tf AS (SELECT id, t, count(*) AS tf, any_value(size) AS size FROM (SELECT *, count(*) OVER (PARTITION BY id) AS size FROM k) GROUP BY 1, 2),
        st AS (SELECT count(DISTINCT id) AS n, sum(tf) / count(DISTINCT id) AS mean FROM tf), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
        r AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS s FROM tf JOIN df USING (t), st WHERE t IN ('small', 'widget') GROUP BY 1 HAVING count(*) = 2)
        SELECT id, round(s + CASE WHEN year = 1960 THEN 1 ELSE 0 END, 6) AS score FROM r JOIN tt USING (id)""",
    "name_and_dates": f"""
        WITH {_TITLES}, f AS (SELECT * FROM tt WHERE list_contains({_TOKENS.format('name')}, 'widget'))
        SELECT id, 'until' AS range FROM f WHERE held_on <= DATE '2024-01-10' UNION ALL SELECT id, 'between' FROM f WHERE held_on BETWEEN DATE '2024-02-01' AND DATE '2024-02-10'""",
    "masked_search": f"""
        WITH {_TITLES} SELECT id FROM tt WHERE list_has_any(list_concat({_TOKENS.format('kind')}, CASE WHEN masked THEN [] ELSE {_TOKENS.format('name')} END), ['economy', 'widget'])""",
    "reindexed": f"""
        WITH {_TITLES}, d AS (SELECT id, CASE WHEN id % 10 = 1 THEN name || ' renewed' ELSE name END AS name FROM tt WHERE id % 10 <> 2), k AS (SELECT id, unnest({_TOKENS.format('name')}) AS t FROM d)
        SELECT 'name' AS field, count(DISTINCT id) AS documents, count(DISTINCT t) AS tokens, count(DISTINCT (id, t)) AS postings FROM k""",
    "consents": "SELECT DISTINCT o_custkey AS pid FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey % 3 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1997-06-01')",
    "keyed_macs": f"""
        SELECT c_custkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(c_name)))) AS mac, sha256('audit-address' || chr(31) || c_custkey || chr(31) || c_mktsegment || chr(31)) AS commitment FROM customer""",
    "record_digests": "SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 = 0 AND s_nationkey <> 99",
    "disclosures": "SELECT user_id AS entity_id, event_id % 4 AS recipient, count(*) AS n FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL",
    "outbox": """
        WITH f AS (SELECT min(event_id) AS bad FROM events WHERE event_id % 4 <> 0 AND event_id % 499 = 498),
        s AS (SELECT event_id, event_type AS topic, ts, CASE WHEN event_id % 4 = 0 THEN ts WHEN event_id < coalesce(bad, 1e18) THEN TIMESTAMP '2024-03-01' END AS p FROM events, f), l AS (SELECT * FROM s WHERE p IS NULL OR p >= TIMESTAMP '2024-01-03')
        SELECT topic, count(*) AS n, count(*) FILTER (p IS NULL) AS n_waiting, max(epoch_us(ts) // 1000) FILTER (p IS NOT NULL) AS watermark_ms, max(event_id) FILTER (p IS NOT NULL) AS "offset" FROM l GROUP BY 1""",
    "urn_parts": """
        WITH s AS (SELECT s_suppkey, ['place:', 'Place:', 'person:', 'person'][CAST(s_suppkey % 4 AS INT) + 1] || s_suppkey AS ref, ['located_in', 'employs', 'knows'][CAST(s_suppkey % 3 AS INT) + 1] AS kind FROM supplier)
        SELECT ref, CASE s_suppkey % 4 WHEN 0 THEN 'place' WHEN 2 THEN 'person' END AS type, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS id, kind, CASE kind WHEN 'located_in' THEN 'location_of' WHEN 'employs' THEN 'employed_by' END AS inverse,
               CASE kind WHEN 'located_in' THEN FALSE WHEN 'employs' THEN TRUE END AS sensitive FROM s""",
    "chains": """
        WITH RECURSIVE o AS (SELECT o_orderkey AS leg, CASE WHEN o_orderkey % 5 < 4 THEN CASE WHEN o_orderkey % 50 = 13 THEN o_orderkey - 3 ELSE o_orderkey + 1 END END AS nxt, o_orderkey % 7 <> 3 AS resolved, epoch_us(o_orderdate) // 1000 AS t0, o_orderkey % 9 * 1000 AS lead FROM orders),
        w AS (SELECT leg AS start, leg, nxt, [leg] AS seen FROM o WHERE leg % 5 = 0 UNION ALL SELECT start, o.leg, o.nxt, list_append(seen, o.leg) FROM w JOIN o ON o.leg = w.nxt WHERE NOT list_contains(seen, o.leg) AND len(seen) < 16),
        g AS (SELECT start, count(*) AS legs, bool_and(resolved) AS complete, min(t0) AS t0, max(t0 + lead) AS t1, CAST(sum(lead) AS BIGINT) AS lead_ms FROM w JOIN o USING (leg) GROUP BY 1)
        SELECT start, legs, complete, CASE WHEN complete THEN t0 END AS t0, CASE WHEN complete THEN t1 END AS t1, CASE WHEN complete THEN lead_ms END AS lead_ms FROM g""",
    "graph_reconciled": """
        WITH w AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'part:' ELSE 'supplier:' END || s_suppkey AS f, 'nation:' || s_nationkey AS t, s_suppkey % 9 = 0 AS bad FROM supplier),
        h AS (SELECT 'supplier:' || s_suppkey AS f, 'nation:' || (s_nationkey + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END) AS t FROM supplier WHERE s_suppkey % 4 <> 0)
        SELECT f AS from_ref, t AS to_ref, 'in' AS kind, 'rejected' AS side FROM w WHERE bad UNION ALL SELECT f, t, 'in', 'missing' FROM w WHERE NOT bad AND (f, t) NOT IN (SELECT (f, t) FROM h)
        UNION ALL SELECT f, t, 'in', 'extra' FROM h WHERE (f, t) NOT IN (SELECT (f, t) FROM w WHERE NOT bad)""",
}
