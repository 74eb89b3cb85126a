"""Files out and in again, masked exports, edges by direction and refreshed review queues, over records made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import disclosure as D
from tessera.operators import relational as R
from tessera.plans.registry import _MASK
from tessera.plans.resolution import _containment
from tessera.session import table, work_path
from tessera.sources import bulk


def file_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records exported as JSON lines, CSV and TSV and read back."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_size % 5 > 0 THEN concat(p_name, ', \"', p_type, '\"') END AS name", "named_struct('brand', p_brand, 'size', p_size) AS made", "array(p_type, CAST(p_size AS STRING)) AS tags")
    out = None
    for kind in ("jsonl", "csv", "tsv"):
        path = work_path(spark, f"export-{kind}")
        bulk.export(p, path, kind)
        rows = bulk.read(spark, path, kind, p.schema).where("__error IS NULL").select(F.lit(kind).alias("kind"), "id", "name", "made.brand", "made.size", F.array_join("tags", "|").alias("tags"))
        out = rows if out is None else out.unionByName(rows)
    return out


def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with broken and keyless lines: what an import would do with each, errors by kind, and the table after it."""
    path = work_path(spark, "import-lines")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    line = F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.lit('{"id":'), "s_name")).when(F.col("s_suppkey") % 10 == 4, F.to_json(F.struct(F.col("s_name").alias("name")))).otherwise(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.upper("s_name").alias("name"))))
    s.select(line.alias("value")).write.text(path)
    rows = bulk.read(spark, path, "jsonl", T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))
    have = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    keyless = rows.where("__error IS NULL AND id IS NULL").select("__row", F.when(F.col("name").like("%4"), 0.9).otherwise(0.3).alias("score"))
    planned = bulk.plan_import(rows, have, "id", keyless)
    counts = planned.groupBy("outcome", "to_review").agg(F.count(F.lit(1)).alias("n"))
    errors = bulk.error_report(planned).groupBy(F.col("message").alias("outcome")).agg(F.lit(None).cast("boolean").alias("to_review"), F.count(F.lit(1)).alias("n"))
    after = R.upsert(have, planned.where("outcome != 'errored' AND id IS NOT NULL").select("id", "name"), ["id"])
    renamed = after.where(F.col("name") == F.upper("name")).agg(F.lit("renamed_or_new").alias("outcome"), F.lit(None).cast("boolean").alias("to_review"), F.count(F.lit(1)).alias("n"))
    return counts.unionByName(errors).unionByName(renamed)


def masked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person records as exports give them by default: tax ids, sensitive identifiers, documents and private contacts masked."""
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS pid", "concat('T-', c_custkey * 7919) AS tax_id", "array(named_struct('identifier_type', CASE WHEN c_custkey % 2 = 0 THEN 'SSN' ELSE 'MRN' END, 'value', concat('A-', c_custkey * 104729))) AS identifiers",
        "array(named_struct('system', CASE WHEN c_custkey % 3 = 0 THEN 'email' ELSE 'phone' END, 'value', concat('+44 ', c_custkey * 31))) AS telecom", "array(named_struct('number', concat('P', c_custkey))) AS documents",
    )
    return D.mask_person(c).select("pid", "tax_id", F.col("identifiers")[0]["value"].alias("identifier"), F.col("telecom")[0]["value"].alias("contact"), F.col("documents")[0]["number"].alias("document"))


def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges out of a nation, into it, and both (F2)."""
    edges = _containment(spark, sf_dir)
    told = [R.incident(edges, "nation:3", d).agg(F.lit(d).alias("direction"), F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("least")) for d in ("out", "in", "both")]
    return told[0].unionByName(told[1]).unionByName(told[2])


def refreshed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review queue after a new scan: decided pairs keep their status, machine merges may fall back."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS a", "o_orderkey + 1 AS b", "o_totalprice AS score", "o_orderstatus AS s")
    queue = o.where("a % 2 = 0").selectExpr("a", "b", "score", "CASE s WHEN 'F' THEN 'pending' WHEN 'O' THEN 'automerged' ELSE 'rejected' END AS status")
    scan = o.where("a % 3 = 0").selectExpr("b AS a", "a AS b", "score + 1 AS score", "CASE WHEN a % 5 = 0 THEN 'automerged' ELSE 'pending' END AS status")
    return R.refresh_reviews(queue, scan)


QUERIES = {f.__name__: f for f in (file_round_trips, import_outcomes, masked_records, incident_edges, refreshed_reviews)}

_M = lambda x: _MASK.format(f"({x})")

ORACLE = {
    "file_round_trips": """
        SELECT kind, p_partkey AS id, CASE WHEN p_size % 5 > 0 THEN p_name || ', "' || p_type || '"' END AS name, p_brand AS brand, p_size AS size, p_type || '|' || p_size AS tags FROM part, (VALUES ('jsonl'), ('csv'), ('tsv')) AS k(kind)""",
    "import_outcomes": """
        WITH p AS (SELECT *, CASE WHEN s_suppkey % 10 = 3 THEN 'errored' WHEN s_suppkey % 10 = 4 THEN 'created' WHEN s_suppkey % 2 = 0 THEN 'upserted' ELSE 'created' END AS outcome, s_suppkey % 10 = 4 AS to_review FROM supplier)
        SELECT outcome, to_review, count(*) AS n FROM p GROUP BY 1, 2 UNION ALL SELECT 'malformed_json', NULL, count(*) FROM p WHERE outcome = 'errored' HAVING count(*) > 0
        UNION ALL SELECT 'renamed_or_new', NULL, count(*) FROM p WHERE s_suppkey % 10 NOT IN (3, 4)""",
    "masked_records": f"""
        WITH c AS (SELECT c_custkey AS pid, 'T-' || (c_custkey * 7919) AS t, 'A-' || (c_custkey * 104729) AS i, '+44 ' || (c_custkey * 31) AS p, 'P' || c_custkey AS d FROM customer)
        SELECT pid, {_M('t')} AS tax_id, CASE WHEN pid % 2 = 0 THEN {_M('i')} ELSE i END AS identifier, CASE WHEN pid % 3 = 0 THEN p ELSE {_M('p')} END AS contact, {_M('d')} AS document FROM c""",
    "incident_edges": """
        WITH e AS (SELECT 'nation:' || n_nationkey AS f, 'region:' || n_regionkey AS t FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier)
        SELECT 'out' AS direction, count(*) AS n, min(f || '>' || t) AS least FROM e WHERE f = 'nation:3' UNION ALL SELECT 'in', count(*), min(f || '>' || t) FROM e WHERE t = 'nation:3' UNION ALL SELECT 'both', count(*), min(f || '>' || t) FROM e WHERE f = 'nation:3' OR t = 'nation:3'""",
    "refreshed_reviews": """
        WITH q AS (SELECT o_orderkey AS a, o_totalprice AS score, CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'automerged' ELSE 'rejected' END AS status FROM orders WHERE o_orderkey % 2 = 0),
        s AS (SELECT o_orderkey AS a, o_totalprice + 1 AS score, CASE WHEN o_orderkey % 5 = 0 THEN 'automerged' ELSE 'pending' END AS status FROM orders WHERE o_orderkey % 3 = 0)
        SELECT a, a + 1 AS b, coalesce(s.score, q.score) AS score, CASE WHEN q.status IS NULL OR q.status <> 'rejected' THEN coalesce(s.status, q.status) ELSE q.status END AS status FROM q FULL JOIN s USING (a)""",
}
