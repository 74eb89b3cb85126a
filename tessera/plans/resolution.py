"""Entity resolution, search, graph and stream queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions import similarity as S
from tessera.operators import evidence as E
from tessera.operators import graph as G
from tessera.operators import relational as R
from tessera.operators import search as Q
from tessera.session import table
from tessera.sources import bulk
from tessera.streaming import events as ST


def _blocks() -> Column:
    return F.array(F.concat_ws("|", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers of one nation and segment whose balances lie in the same thousand."""
    return R.blocked_pairs(table(spark, sf_dir, "customer"), "c_custkey", _blocks())


def _both(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", *columns)
    a, b = (c.select(*[F.col(x).alias(f"{s}_{x}") for x in c.columns]) for s in "ab")
    return _pairs(spark, sf_dir).join(a, F.col("a") == F.col("a_c_custkey")).join(b, F.col("b") == F.col("b_c_custkey"))


def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both Levenshtein similarities of blocked pairs."""
    p = _both(spark, sf_dir, "c_name")
    return p.select("a", "b", F.round(S.levenshtein_bytes("a_c_name", "b_c_name"), 9).alias("by_bytes"), F.round(S.levenshtein("a_c_name", "b_c_name"), 9).alias("by_chars"))


def jaro_winkler_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the 25 nations against each other."""
    n = table(spark, sf_dir, "nation").select("n_name")
    pairs = n.join(F.broadcast(n.withColumnRenamed("n_name", "other")), F.col("n_name") < F.col("other"))
    return pairs.select("n_name", "other", F.round(S.jaro_winkler("n_name", "other"), 9).alias("jw"))


def soundex_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both Soundex variants of nation names."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_name", S.soundex_reset("n_name").alias("reset"), S.soundex("n_name").alias("transparent"), S.phonetic(S.soundex_reset("n_name"), S.soundex_reset(F.lower("n_name"))).alias("same"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.select("s_suppkey", (F.col("s_suppkey") * 37 % 180 - 90).cast("double").alias("lat"), (F.col("s_suppkey") * 91 % 360 - 180).cast("double").alias("lon"))


def haversine_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within 3000 km of a point across the antimeridian, box first."""
    w, s, e, n = S.search_box(10.0, 175.0, 3_000_000)
    p = _placed(spark, sf_dir).where(S.in_box(F.col("lat"), F.col("lon"), w, s, e, n))
    m = S.haversine_m(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(175.0))
    p = p.withColumn("m", m).where("m <= 3000000")
    return p.select("s_suppkey", F.round("m", 1).alias("metres"), F.round(S.geo_reciprocal(F.col("m")), 9).alias("reciprocal"), F.round(S.gaussian(F.col("m"), 1_000_000.0), 9).alias("gaussian"), F.round(S.geo_decay(F.col("m") / 1000), 9).alias("decay"))


def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a parsed box, as GeoJSON features."""
    p = _placed(spark, sf_dir).where(S.in_box(F.col("lat"), F.col("lon"), *S.parse_box("-60,-40,90.5,55")))
    return p.select("s_suppkey", bulk.geojson(F.col("lon"), F.col("lat"), id=F.col("s_suppkey")).alias("feature"))


def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GTIN and ten-digit mod-11 checks of numbers made from part keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7_919_317).cast("string"), 13, "4").alias("gtin"), F.lpad((F.col("p_partkey") * 104_729).cast("string"), 10, "9").alias("nhs"))
    return p.select("p_partkey", N.gs1("gtin", 13).alias("gtin_ok"), N.nhs_number("nhs").alias("nhs_ok"))


def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of pages and how many pages each has."""
    return table(spark, sf_dir, "pages").select(N.domain("url").alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _both(spark, sf_dir, "c_name", "c_acctbal", "c_mktsegment")
    money = S.gaussian(F.abs(F.col("a_c_acctbal") - F.col("b_c_acctbal")), 50.0)
    return p.select("a", "b", S.levenshtein("a_c_name", "b_c_name").alias("name"), money.alias("money"), F.when(F.col("a") % 3 > 0, 1.0).alias("segment"))


def evidence_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of evidence and strength of blocked pairs."""
    p = _scored(spark, sf_dir)
    e = E.evidence({"family_name": F.col("name"), "address": F.col("money"), "gender": F.col("segment")}, groups=[{"address", "gender"}], is_match=F.col("name") >= 0.9, proof=15.0)
    return p.withColumn("e", e).select("a", "b", F.round("e.weight_bits", 6).alias("bits"), F.col("e.fields_compared").alias("fields"), F.col("e.strength").alias("strength"))


def weighted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies for missing scores, quality and confidence."""
    p = _scored(spark, sf_dir)
    parts = [(F.col("name"), 0.5), (F.col("money"), 0.3), (F.col("segment"), 0.2)]
    p = p.withColumns({"renormalized": F.round(S.weighted(*parts), 9), "fixed": F.round(S.weighted(*parts, renormalize=False), 9)})
    return p.select("a", "b", "renormalized", "fixed", E.quality(F.col("renormalized"), 0.7).alias("quality"), E.confidence_band(F.col("renormalized")).alias("confidence"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs above a threshold, best first in each record, with their gate."""
    p = _scored(spark, sf_dir).withColumn("score", F.round(S.weighted((F.col("name"), 0.6), (F.col("money"), 0.4)), 9)).where("score >= 0.75")
    status = E.auto_merge(F.col("score"), F.when(F.col("money") > 0.99, "Proven").otherwise("Consistent"))
    return R.ranked(p.select("a", "b", "score", status.alias("status")), F.desc("score"), "b", keys=("a",))


def identity_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of customers chained by nation, segment and thousand of balance."""
    return G.identity_closure(R.block_stars(table(spark, sf_dir, "customer"), "c_custkey", _blocks()))


def _containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("from_ref"), F.concat(F.lit("region:"), "n_regionkey").alias("to_ref"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("from_ref"), F.concat(F.lit("nation:"), "s_nationkey").alias("to_ref"))
    return n.unionByName(s).withColumns({"kind": F.lit("contained_in"), "edge_id": F.concat_ws(">", "from_ref", "to_ref")})


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All refs within two hops of one region."""
    start = spark.createDataFrame([("region:1",)], "ref string")
    return G.neighbours(_containment(spark, sf_dir), start, 2, ["contained_in"])


def graph_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after odd nations merge into the even ones before them, with their status."""
    merges = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 1").select(F.concat(F.lit("nation:"), "n_nationkey").alias("old"), F.concat(F.lit("nation:"), F.col("n_nationkey") - 1).alias("new"))
    presence = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("ref"), (F.col("r_regionkey") != 2).alias("alive")).unionByName(
        table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit("nation:"), "n_nationkey").alias("ref"), F.lit(True).alias("alive")))
    edges = G.repoint(_containment(spark, sf_dir), merges, [])
    edges = G.permitted(edges, [("contained_in", "nation", "region"), ("contained_in", "supplier", "nation")])
    return G.status(edges, presence).select("from_ref", "to_ref", "kind", "status")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.postings(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", ["text"])


def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a boolean query with their BM25 score and number."""
    found = Q.matches(_index(spark, sf_dir), "the and of NOT hethe", "item_id")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.crossJoin(F.broadcast(total)).select("item_id", F.round("score", 6).alias("score"), "total")


def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tokens near the words (T4, T5)."""
    return Q.fuzzy(_index(spark, sf_dir), "thes andin", "item_id")


def candidate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy or phonetic candidates."""
    return Q.candidates(_index(spark, sf_dir), "thand", "item_id")


def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that documents break, by rule."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rules = {"text_required": F.trim("text") != "", "text_long": F.char_length("text") <= 10_000, "lang_form": F.col("lang").rlike("^[a-z]{2}$"), "source_known": F.col("source").rlike(r"^src\d$")}
    return N.validate(d, rules).select(F.explode("errors").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one nation folded into its first one."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.array(F.col("s_nationkey").cast("string")).alias("places"))
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("main"))
    merges = s.join(F.broadcast(first), "s_nationkey").where("s_suppkey != main").select("main", F.col("s_suppkey").alias("duplicate"))
    out = G.merge_fold(s, merges, "s_suppkey", "s_name", ["places"], ["s_nationkey"])
    return out.select("s_suppkey", "s_name", F.size("alternate_names").alias("n_alternates"), F.array_join("places", ",").alias("places"), "s_nationkey")


def stream_dedup_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed as a stream, each once, and the users' last state."""
    path = f"{sf_dir}/events.parquet"
    rows = ST.dedup_files(spark, path, spark.read.parquet(path).schema, ["event_id"], "ts")
    e = rows.select(F.lit("user").alias("entity"), F.col("user_id").cast("string").alias("pid"), F.when(F.col("event_type") == "error", "deleted").otherwise("updated").alias("kind"), F.col("event_id").alias("seq"))
    empty = spark.createDataFrame([], "ref string, alive boolean, last_seq long")
    return ST.apply_presence(empty, e)


def event_log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log of journeys."""
    from tessera.plans.journeys import segments

    return bulk.event_log(segments(spark, sf_dir), "user_id")


QUERIES = {f.__name__: f for f in (
    levenshtein_pairs, jaro_winkler_nations, soundex_codes, haversine_nearby, bounding_box, check_digits, page_domains, evidence_bits, weighted_average, review_queue, identity_closure,
    graph_neighbours, graph_repoint, token_search, fuzzy_search, candidate_search, validation_errors, merged_records, stream_dedup_presence, event_log_export,
)}

_P = """p AS (SELECT x.c_custkey AS a, y.c_custkey AS b, x.c_name AS an, y.c_name AS bn, abs(x.c_acctbal - y.c_acctbal) AS diff FROM customer x JOIN customer y
    ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment = y.c_mktsegment AND floor(x.c_acctbal / 1000) = floor(y.c_acctbal / 1000) AND x.c_custkey < y.c_custkey)"""
_SC = f"""{_P}, sc AS (SELECT a, b, 1 - levenshtein(an, bn) / greatest(length(an), length(bn)) AS name, exp(-pow(diff / 50, 2)) AS money, CASE WHEN a % 3 > 0 THEN 1.0 END AS segment FROM p)"""
_BITS = lambda c, m, u: f"(CASE WHEN {c} >= 0.95 THEN log2({m} / {u}) WHEN {c} <= 0.6 THEN log2((1 - {m}) / (1 - {u})) ELSE log2((1 - {m}) / (1 - {u})) + (log2({m} / {u}) - log2((1 - {m}) / (1 - {u}))) * ({c} - 0.6) / 0.35 END)"
_TOK = "tok AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS t FROM benchmark)"
_PLACE = "pl AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 180 - 90 AS DOUBLE) AS lat, CAST(s_suppkey * 91 % 360 - 180 AS DOUBLE) AS lon FROM supplier)"



def _soundex(x: str, transparent: bool = False) -> str:
    """SQL: Soundex; H and W are passed over where ``transparent``, and otherwise part equal codes."""
    t = f"upper(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    s = f"({t}[1:1] || regexp_replace({t}[2:], '[HW]', '', 'g'))" if transparent else t
    d = f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    runs = f"array_to_string([substr({d}, i, 1) FOR i IN range(2, length({d}) + 1) IF substr({d}, i, 1) <> substr({d}, i - 1, 1)], '')"
    return f"CASE WHEN {t} = '' THEN {'NULL' if transparent else repr('')} ELSE {t}[1:1] || rpad(replace({runs}, '0', ''), 3, '0') END"


ORACLE = {
    "soundex_codes": f"SELECT n_name, {_soundex('n_name')} AS reset, {_soundex('n_name', True)} AS transparent, CAST(1 AS DOUBLE) AS same FROM nation",
    "candidate_search": f"WITH {_TOK} SELECT DISTINCT item_id FROM tok WHERE levenshtein(t, 'thand') <= 1 OR {_soundex('t', True)} = 'T530'",
    "levenshtein_pairs": f"WITH {_P} SELECT a, b, round(1 - levenshtein(an, bn) / greatest(strlen(an), strlen(bn)), 9) AS by_bytes, round(1 - levenshtein(an, bn) / greatest(length(an), length(bn)), 9) AS by_chars FROM p",
    "jaro_winkler_nations": "SELECT x.n_name, y.n_name AS other, round(jaro_winkler_similarity(x.n_name, y.n_name), 9) AS jw FROM nation x JOIN nation y ON x.n_name < y.n_name",
    "haversine_nearby": f"""
        WITH {_PLACE}, d AS (SELECT s_suppkey, 2 * 6371000.0 * asin(least(sqrt(pow(sin(radians(10.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(175.0 - lon) / 2), 2)), 1.0)) AS m FROM pl)
        SELECT s_suppkey, round(m, 1) AS metres, round(1 / (1 + m / 1000), 9) AS reciprocal, round(exp(-pow(m / 1000000, 2)), 9) AS gaussian, round(1 / exp(m / 1000 / 1000 / 2), 9) AS decay FROM d WHERE m <= 3000000""",
    "bounding_box": f"""
        WITH {_PLACE} SELECT s_suppkey, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"id":' || s_suppkey || '}}}}' AS feature
        FROM pl WHERE lat BETWEEN -40 AND 55 AND lon BETWEEN -60 AND 90.5""",
    "check_digits": """
        WITH n AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919317 AS VARCHAR), 13, '4') AS g, lpad(CAST(p_partkey * 104729 AS VARCHAR), 10, '9') AS h FROM part),
        s AS (SELECT *, list_sum([CAST(substr(g, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END for i in range(1, 14)]) AS gs, 11 - list_sum([CAST(substr(h, i, 1) AS INT) * (11 - i) for i in range(1, 10)]) % 11 AS r FROM n)
        SELECT p_partkey, gs % 10 = 0 AS gtin_ok, (CASE WHEN r = 11 THEN 0 ELSE r END) = CAST(substr(h, 10, 1) AS INT) AS nhs_ok FROM s""",
    "page_domains": """
        SELECT regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)', 1), '\\.$', ''), '^www\\.', '') AS domain, count(*) AS n FROM pages GROUP BY 1""",
    "evidence_bits": f"""
        WITH {_SC}, w AS (SELECT *, {_BITS('name', 0.92, 0.005)} AS f, {_BITS('money', 0.70, 1e-4)} AS ad, CASE WHEN segment IS NOT NULL THEN {_BITS('segment', 0.98, 0.5)} END AS g FROM sc),
        t AS (SELECT *, f + CASE WHEN g IS NULL THEN ad WHEN abs(ad) >= abs(g) THEN ad + 0.5 * g ELSE g + 0.5 * ad END AS total FROM w)
        SELECT a, b, round(total, 6) AS bits, 2 + (segment IS NOT NULL)::INT AS fields, CASE WHEN total >= 15 THEN 'Proven' WHEN name >= 0.9 THEN 'Consistent' ELSE 'NonMatch' END AS strength FROM t""",
    "weighted_average": f"""
        WITH {_SC}, w AS (SELECT a, b, round((name * 0.5 + money * 0.3 + coalesce(segment, 0) * 0.2) / CASE WHEN segment IS NULL THEN 0.8 ELSE 1.0 END, 9) AS renormalized, round(name * 0.5 + money * 0.3 + coalesce(segment, 0) * 0.2, 9) AS fixed FROM sc)
        SELECT *, CASE WHEN renormalized >= 0.95 THEN 'Definite' WHEN renormalized >= 0.7 THEN 'Probable' WHEN renormalized >= 0.5 THEN 'Possible' ELSE 'Unlikely' END AS quality,
               CASE WHEN renormalized >= 0.95 THEN 'High' WHEN renormalized >= 0.7 THEN 'Medium' ELSE 'Low' END AS confidence FROM w""",
    "review_queue": f"""
        WITH {_SC}, q AS (SELECT a, b, round(name * 0.6 + money * 0.4, 9) AS score, money FROM sc WHERE round(name * 0.6 + money * 0.4, 9) >= 0.75)
        SELECT a, b, score, CASE WHEN score >= 0.95 AND money > 0.99 THEN 'automerged' ELSE 'pending' END AS status, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS rank FROM q""",
    "identity_closure": """
        WITH g AS (SELECT c_custkey, min(c_custkey) OVER w AS m, count(*) OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 1000)))
        SELECT c_custkey AS ref, m AS identity FROM g WHERE n > 1""",
    "graph_neighbours": """
        SELECT 'region:1' AS ref, 0 AS depth UNION ALL SELECT 'nation:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1
        UNION ALL SELECT 'supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1""",
    "graph_repoint": """
        WITH e AS (SELECT DISTINCT 'nation:' || (n_nationkey - n_nationkey % 2) AS from_ref, 'region:' || n_regionkey AS to_ref FROM nation
                   UNION SELECT DISTINCT 'supplier:' || s_suppkey, 'nation:' || (s_nationkey - s_nationkey % 2) FROM supplier)
        SELECT from_ref, to_ref, 'contained_in' AS kind, CASE WHEN to_ref = 'region:2' THEN 'dangling' WHEN from_ref LIKE 'nation:%' AND CAST(split_part(from_ref, ':', 2) AS INT) < 20 THEN 'verified' ELSE 'unverified' END AS status FROM e""",
    "token_search": f"""
        WITH {_TOK}, tf AS (SELECT item_id, t, count(*) AS tf, any_value(size) AS size FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS size FROM tok) GROUP BY 1, 2),
        st AS (SELECT count(DISTINCT item_id) AS n, sum(tf) / count(DISTINCT item_id) AS mean FROM tf), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
        r AS (SELECT item_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN df USING (t), st WHERE t IN ('the', 'and', 'of')
              AND item_id NOT IN (SELECT item_id FROM tf WHERE t = 'hethe') GROUP BY 1)
        SELECT item_id, round(score, 6) AS score, count(*) OVER () AS total FROM r""",
    "fuzzy_search": f"""
        WITH {_TOK}, w(w, k) AS (VALUES ('thes', 1), ('andin', 1)) SELECT item_id, count(DISTINCT w) AS hits FROM tok JOIN w ON levenshtein(t, w) <= k GROUP BY 1""",
    "validation_errors": """
        WITH e AS (SELECT unnest([CASE WHEN trim(text) = '' THEN 'text_required' END, CASE WHEN length(text) > 10000 THEN 'text_long' END, CASE WHEN NOT regexp_matches(lang, '^[a-z]{2}$') THEN 'lang_form' END,
                   CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source_known' END]) AS rule FROM documents)
        SELECT rule, count(*) AS n FROM e WHERE rule IS NOT NULL GROUP BY 1""",
    "merged_records": """
        SELECT min(s_suppkey) AS s_suppkey, arg_min(s_name, s_suppkey) AS s_name, CAST(count(DISTINCT s_name) - 1 AS INTEGER) AS n_alternates, CAST(s_nationkey AS VARCHAR) AS places, s_nationkey FROM supplier GROUP BY s_nationkey""",
    "stream_dedup_presence": """
        SELECT 'user:' || user_id AS ref, arg_max(event_type <> 'error', event_id) AS alive, max(event_id) AS last_seq FROM events GROUP BY user_id""",
    "event_log_export": """
        WITH s AS (SELECT user_id, event_type, (epoch_us(ts) // 1000) AS a, (epoch_us(ts) // 1000) + greatest(60000, CAST(floor(value * 360000) AS BIGINT)) AS b FROM events)
        SELECT user_id AS "case", event_type AS activity, 'start' AS lifecycle, a AS timestamp_ms FROM s UNION ALL SELECT user_id, event_type, 'complete', b FROM s""",
}
