"""Scores of persons, workers, places, things and organizations, and the rules that settle a match, over records made from the driver's tables.

Records are compared within blocks of eight neighbouring keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identifiers as I
from tessera.functions import normalize as N
from tessera.functions import similarity as S
from tessera.operators import evidence as E
from tessera.operators import relational as R
from tessera.session import table

GIVEN = ["william", "bill", "robert", "bob", "james", "jim", "anna", "marie"]


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").withColumnRenamed("c_custkey", "k")
    return c.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(  # 25 nations
        "k",
        f"element_at(array({', '.join(map(repr, GIVEN))}), CAST(k % 8 AS INT) + 1) AS given",
        "CASE WHEN k % 5 = 0 THEN replace(lower(n_name), 'a', 'e') ELSE lower(n_name) END AS family",
        "CASE WHEN k % 4 = 0 THEN array('Dr') WHEN k % 4 = 1 THEN array('Dr.') ELSE array() END AS prefix",
        "CASE WHEN k % 6 = 0 THEN array('Jr') ELSE array() END AS suffix",
        "CASE WHEN k % 11 > 0 THEN date_add(DATE'1950-01-01', CAST(k % 7 * 31 + k % 3 AS INT)) END AS birth",
        "element_at(array('male', 'female', 'unknown'), CAST(k % 3 AS INT) + 1) AS gender",
        "concat(lpad(CAST(k % 50 DIV 4 * 631 AS STRING), 5, '0'), CASE WHEN k % 2 = 0 THEN concat('-', lpad(CAST(k % 97 AS STRING), 4, '0')) ELSE '' END) AS postal",
        "concat(CAST(k % 40 DIV 4 AS STRING), element_at(array(' Main Street', ' Main St.', ' Oak Avenue', ' Oak Ave,'), CAST(k % 4 AS INT) + 1)) AS street",
        "c_mktsegment AS city", "CASE WHEN k % 7 > 0 THEN CAST(c_nationkey AS STRING) END AS state",
        "named_struct('type', CASE WHEN k % 2 = 0 THEN 'MRN' ELSE 'DL' END, 'system', 's', 'value', concat(CASE WHEN k % 4 < 2 THEN 'A-' ELSE 'A ' END, CAST(k DIV 4 AS STRING))) AS identifier",
        "CASE WHEN k % 3 > 0 THEN concat(CASE WHEN k % 2 = 0 THEN 'T-' ELSE 't' END, CAST(k DIV 6 AS STRING)) END AS tax",
        "named_struct('type', 'passport', 'number', concat(CASE WHEN k % 2 = 0 THEN 'p.' ELSE 'P ' END, CAST(k DIV 5 AS STRING)), 'country', element_at(array('GB', 'IE'), CAST(k % 2 AS INT) + 1)) AS document",
    )


def _paired(rows: DataFrame, key: str = "k") -> DataFrame:
    """Pairs of rows in blocks of eight keys, columns prefixed a_ and b_."""
    a, b = (rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns]) for s in "ab")
    pairs = R.blocked_pairs(rows, key, F.array(F.expr(f"CAST({key} DIV 8 AS STRING)")))
    return pairs.join(a, F.col("a") == F.col(f"a_{key}")).join(b, F.col("b") == F.col(f"b_{key}"))


def _name(p: DataFrame) -> DataFrame:
    p = p.withColumns({"family": S.family_name("a_family", "b_family"), "given": S.given_name("a_given", "b_given"), "prefix": S.name_part_lists("a_prefix", "b_prefix"), "suffix": S.name_part_lists("a_suffix", "b_suffix")})
    return p.withColumn("name", S.full_name(F.col("family"), F.col("given"), F.col("prefix"), F.col("suffix")))


def _postal_score() -> Column:
    return S.postal_code(F.col("a_postal"), F.col("b_postal"))


def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and given names with nicknames and sound, prefixes, suffixes, and the whole name."""
    p = _name(_paired(_persons(spark, sf_dir).select("k", "given", "family", "prefix", "suffix")))
    return p.select("a", "b", *(F.round(c, 9).alias(c) for c in ("family", "given", "prefix", "suffix", "name")))


def combined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaro-Winkler and Levenshtein in one score, with the lift for nicknames."""
    p = _paired(_persons(spark, sf_dir).select("k", "given"))
    both = S.combined("a_given", "b_given")
    return p.select("a", "b", F.round(both, 9).alias("combined"), F.round(S.lifted("a_given", "b_given", both), 9).alias("lifted"))


def address_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postal codes, streets, and whole addresses by fixed and by renormalized weights."""
    p = _paired(_persons(spark, sf_dir).select("k", "postal", "street", "city", "state"))
    p = p.withColumns({"postal": _postal_score(), "street": S.jaro_winkler(S.street("a_street"), S.street("b_street")), "city": S.exact_or_jaro_winkler(F.col("a_city"), F.col("b_city")), "state": (F.col("a_state") == F.col("b_state")).cast("double")})
    fixed = S.address_fixed(*map(F.col, ("postal", "city", "state", "street")))
    present = S.address_present(F.col("postal"), F.col("city"), F.col("street"), F.col("state"), F.lit(None).cast("double"))
    return p.select("a", "b", F.round("postal", 9).alias("postal"), F.round("street", 9).alias("street"), F.round(fixed, 9).alias("fixed"), F.round(present, 9).alias("present"))


def identifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gender, identifiers, tax ids, documents, and the best over two postal codes each."""
    p = _paired(_persons(spark, sf_dir).select("k", "gender", "identifier", "tax", "document", F.array("postal", F.reverse("postal")).alias("postals")))
    return p.select(
        "a", "b", S.gender("a_gender", "b_gender").alias("gender"), S.identifier(F.col("a_identifier"), F.col("b_identifier")).alias("identifier"), S.tax_id(F.col("a_tax"), F.col("b_tax")).alias("tax"),
        S.document(F.col("a_document"), F.col("b_document")).alias("document"), S.best_of("a_postals", "b_postals", S.postal_code).alias("postal"),
    )


def person_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by weights and by rules, workers without renormalizing, the swapped birth date and the summary."""
    p = _name(_paired(_persons(spark, sf_dir)))
    p = p.withColumns({
        "dob": S.birth_date("a_birth", "b_birth"), "sex": S.gender("a_gender", "b_gender"), "id": S.identifier(F.col("a_identifier"), F.col("b_identifier")), "tax": S.tax_id(F.col("a_tax"), F.col("b_tax")),
        "doc": S.document(F.col("a_document"), F.col("b_document")), "address": _postal_score(),
    })
    parts = [F.col(c) for c in ("name", "dob", "sex", "address", "id", "tax", "doc")]
    told = dict(zip(("name", "dob", "gender", "address", "identifier", "tax", "document"), parts))
    return p.select(
        "a", "b", F.round(E.person_probability(*parts), 9).alias("probability"), F.round(E.person_rules(*parts), 9).alias("rules"), F.round(E.person_probability(*parts, renormalize=False), 9).alias("worker"),
        F.coalesce(E.swapped_birth_date(F.col("a_birth"), F.col("b_birth")), F.lit(-1.0)).alias("swapped"), E.summary(told).alias("summary"),
    )


def spec_person_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matcher's person score, in its default and its strict mode."""
    p = _paired(_persons(spark, sf_dir).select("k", "family", "birth", "gender", "identifier"))
    same_id = F.col("a_identifier") == F.col("b_identifier")
    dob = E.swapped_birth_date(F.col("a_birth"), F.col("b_birth"))
    sex = F.when((F.col("a_gender") != "unknown") & (F.col("b_gender") != "unknown"), (F.col("a_gender") == F.col("b_gender")).cast("double"))
    args = (same_id.cast("double"), S.levenshtein("a_family", "b_family"), F.lit(None).cast("double"), F.when(F.col("a_birth").isNotNull() & F.col("b_birth").isNotNull(), dob), F.lit(None).cast("double"), {"gender": sex}, S.soundex_reset("a_family") == S.soundex_reset("b_family"), same_id)
    return p.select("a", "b", F.round(E.spec_person(*args), 9).alias("score"), F.round(E.spec_person(*args, strict=True), 9).alias("strict"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return s.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(  # 25 nations
        "k", "lower(n_name) AS name", "CASE WHEN k % 5 > 0 THEN CAST(k DIV 4 * 37 % 180 - 90 AS DOUBLE) END AS lat", "CAST(k % 4 / 100 AS DOUBLE) AS lon", "CASE WHEN k % 6 > 0 THEN k % 2 END AS kind",
        "CASE WHEN k % 3 > 0 THEN k DIV 3 END AS gln", "CASE WHEN k % 4 > 0 THEN k DIV 2 END AS other_id",
    )


def place_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by name, distance, kind and identifiers; an equal GLN settles it."""
    p = _paired(_places(spark, sf_dir))
    metres = S.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    sound = S.soundex_reset("a_name") == S.soundex_reset("b_name")
    score = E.place_score(S.levenshtein("a_name", "b_name"), S.geo_reciprocal(metres), F.lit(None).cast("double"), F.when(F.col("a_kind").isNotNull() & F.col("b_kind").isNotNull(), (F.col("a_kind") == F.col("b_kind")).cast("double")),
                          (F.col("a_other_id") == F.col("b_other_id")).cast("double"), F.coalesce(F.col("a_gln") == F.col("b_gln"), F.lit(False)), sound)
    p = p.withColumn("score", F.round(score, 6))
    return p.select("a", "b", "score", E.certainty(F.col("score")).alias("certainty"))


def place_name_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of equal names by how common they are."""
    places = _places(spark, sf_dir)
    share = places.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    shares = share.crossJoin(F.broadcast(places.agg(F.count(F.lit(1)).alias("total")))).select("name", (F.col("n") / F.col("total")).alias("share"))
    p = _paired(places.select("k", "name")).join(shares.select(F.col("name").alias("a_name"), "share"), "a_name")
    same = F.map_from_arrays(F.array("a_name"), F.array("share"))
    p = p.withColumns({"known": same, "names": F.array_intersect(F.array("a_name"), F.array("b_name"))}).withColumn("most", E.name_share("names", "known"))
    e = E.evidence({"name": S.levenshtein("a_name", "b_name")}, E.OTHERS["place"], shares={"name": F.col("most")})
    return p.withColumn("e", e).select("a", "b", F.round("most", 9).alias("share"), F.round("e.weight_bits", 6).alias("bits"))


def _things(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), "p_type").selectExpr(
        "k", "name", "p_type AS description", "concat(CASE WHEN k % 2 = 0 THEN 'https://' ELSE 'HTTP://' END, 'ex', CAST(k DIV 4 AS STRING), '.org/', CAST(k DIV 2 AS STRING), CASE WHEN k % 3 = 0 THEN '/' ELSE '' END) AS url",
        "CASE WHEN k % 4 > 0 THEN concat('isbn', CAST(k DIV 7 AS STRING)) END AS isbn", "CASE WHEN k % 3 > 0 THEN concat('sku', CAST(k DIV 2 AS STRING)) END AS sku",
    )


def thing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Things by name, identifier, description and URL; an equal ISBN settles it."""
    p = _paired(_things(spark, sf_dir))
    url = S.url(N.clean_url("a_url"), N.clean_url("b_url"))
    score = E.thing_score(S.levenshtein("a_name", "b_name"), (F.col("a_sku") == F.col("b_sku")).cast("double"), S.levenshtein("a_description", "b_description"), url, F.lit(None).cast("double"), F.coalesce(F.col("a_isbn") == F.col("b_isbn"), F.lit(False)), F.lit(False))
    return p.select("a", "b", url.alias("url"), F.round(score, 9).alias("score"))


def deterministic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three rules that things meet: an equal identifier, a scoped one, a common page."""
    t = _things(spark, sf_dir).selectExpr("k", "array_compact(array(CASE WHEN isbn IS NOT NULL THEN struct('isbn' AS scheme, isbn AS value) END)) AS ids", "array_compact(array(CASE WHEN sku IS NOT NULL THEN struct('shop' AS scope, 'sku' AS scheme, sku AS value) END)) AS scoped", "array(lower(url)) AS pages")
    return _paired(t).select("a", "b", E.rule_match("a_ids", "b_ids", "a_scoped", "b_scoped", "a_pages", "b_pages").alias("rule")).where("rule IS NOT NULL")


def evidence_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of agreement and of disagreement of each component of each entity."""
    rows = [(e, k, m, u) for e, t in {"person": E.PERSON, **E.OTHERS}.items() for k, (m, u) in t.items()]
    t = spark.createDataFrame(rows, "entity string, component string, m double, u double")
    return t.select("entity", "component", F.round(F.log2(F.col("m") / F.col("u")), 9).alias("agree"), F.round(F.log2((1 - F.col("m")) / (1 - F.col("u"))), 9).alias("differ"))


def organization_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organizations by a matcher's weights, against each of its presets."""
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_name AS name", "s_nationkey AS country", "concat('d', CAST(s_suppkey DIV 2 AS STRING), '.org') AS domain", "CASE WHEN s_suppkey % 3 > 0 THEN array(CAST(s_suppkey % 4 AS STRING), CAST(s_suppkey % 5 AS STRING)) END AS keywords")
    p = _paired(s)
    scores = {"name": S.levenshtein("a_name", "b_name"), "url": (F.col("a_domain") == F.col("b_domain")).cast("double"), "jurisdiction": (F.col("a_country") == F.col("b_country")).cast("double"), "keywords": R.jaccard("a_keywords", "b_keywords")}
    told = {preset: E.configured(scores, E.WEIGHTS["organization"], preset) for preset in E.THRESHOLDS}
    return p.select("a", "b", F.round(told["default"][0], 9).alias("score"), *(m.alias(f"is_{k}") for k, (_, m) in told.items()))


def query_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record against all others: scored, those of half and more, best first."""
    p = _persons(spark, sf_dir).select("k", "given", "family", "postal")
    one = p.where("k = 8").select(*[F.col(c).alias(f"q_{c}") for c in ("given", "family", "postal")])
    rows = p.where("k != 8").crossJoin(F.broadcast(one))  # one row
    score = S.weighted((S.levenshtein("given", "q_given"), 0.4), (S.levenshtein("family", "q_family"), 0.4), (S.postal_code(F.col("postal"), F.col("q_postal")), 0.2))
    rows = rows.select("k", F.round(score, 9).alias("score")).where("score >= 0.5")
    return R.ranked(rows, F.desc("score"), "k")


def identity_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers that may be one: same nation, near balance; edges with confidence below 1, the 100 best a run."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("person:"), "c_custkey").alias("from_ref"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"), F.floor(F.col("c_acctbal") / 100).alias("at"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("worker:"), "s_suppkey").alias("to_ref"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("y"), F.floor(F.col("s_acctbal") / 100).alias("at"))
    near = c.join(s, ["nation", "at"]).select("from_ref", "to_ref", F.round(F.least(S.gaussian(F.abs(F.col("x") - F.col("y")), 50.0), F.lit(0.99)), 9).alias("confidence")).where("confidence >= 0.5")
    return near.orderBy(F.desc("confidence"), "from_ref", "to_ref").limit(100).withColumns({"kind": F.lit("same_identity"), "provenance": F.lit("matcher_suggested")})


def national_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of some made-up numbers pass each national scheme's check."""
    o = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey * 982451653 % 1000000000000 AS BIGINT) AS x")
    text = lambda n: F.lpad((F.col("x") % 10**n).cast("string"), n, "0")
    tests = {name: test(text(n)) for name, (n, test) in I.NUMERIC.items()}
    counts = o.agg(*(F.count_if(t).alias(k) for k, t in tests.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("scheme"), F.col(k).alias("n_valid")) for k in tests))))


QUERIES = {f.__name__: f for f in (
    name_scores, combined_names, address_scores, identifier_scores, person_scores, spec_person_scores, place_scores, place_name_shares, thing_scores, deterministic_rules, evidence_tables, organization_matches, query_candidates,
    identity_suggestions, national_identifiers,
)}


def _sound(x: str) -> str:
    """SQL: the Soundex in which H and W part equal codes."""
    s = f"regexp_replace(upper(trim({x})), '[^A-Z]', '', 'g')"
    d = f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    runs = f"array_to_string([substr({d}, i, 1) FOR i IN range(2, length({d}) + 1) IF substr({d}, i, 1) <> substr({d}, i - 1, 1)], '')"
    return f"CASE WHEN {s} = '' THEN '' ELSE substr({s}, 1, 1) || rpad(replace({runs}, '0', ''), 3, '0') END"


def _jw(x: str, y: str) -> str:
    return f"jaro_winkler_similarity({x}, {y})"


def _lev(x: str, y: str) -> str:
    return f"(CASE WHEN greatest(length({x}), length({y})) = 0 THEN 1.0 ELSE 1 - levenshtein({x}, {y}) / greatest(length({x}), length({y})) END)"


def _postal(x: str, y: str) -> str:
    x, y = f"replace(trim({x}), '-', '')", f"replace(trim({y}), '-', '')"
    return f"(CASE WHEN {x} = {y} THEN 1.0 WHEN length({x}) >= 5 AND length({y}) >= 5 AND {x}[1:5] = {y}[1:5] THEN 0.95 WHEN length({x}) >= 3 AND length({y}) >= 3 AND {x}[1:3] = {y}[1:3] THEN 0.7 ELSE 0.0 END)"


def _mean(*parts: tuple[str, float]) -> str:
    """SQL: the weighted mean over parts that aren't null."""
    top, weight = " + ".join(f"coalesce({s}, 0) * {w}" for s, w in parts), " + ".join(f"CASE WHEN {s} IS NULL THEN 0 ELSE {w} END" for s, w in parts)
    return f"(CASE WHEN ({weight}) > 0 THEN ({top}) / ({weight}) ELSE 0.0 END)"


def _bonus(score: str, sound: str) -> str:
    return f"(CASE WHEN {score} < 0.95 AND {sound} THEN least({score} + 0.05, 1.0) ELSE {score} END)"


_PER = f"""per AS (SELECT c_custkey AS k, [{', '.join(map(repr, GIVEN))}][CAST(c_custkey % 8 AS INT) + 1] AS given, ['w', 'w', 'r', 'r', 'j', 'j', NULL, NULL][CAST(c_custkey % 8 AS INT) + 1] AS nick,
    CASE WHEN c_custkey % 5 = 0 THEN replace(lower(n_name), 'a', 'e') ELSE lower(n_name) END AS family, CASE WHEN c_custkey % 4 = 0 THEN 'Dr' WHEN c_custkey % 4 = 1 THEN 'Dr.' END AS prefix, CASE WHEN c_custkey % 6 = 0 THEN 'Jr' END AS suffix,
    CASE WHEN c_custkey % 11 > 0 THEN DATE '1950-01-01' + CAST(c_custkey % 7 * 31 + c_custkey % 3 AS INT) END AS birth, ['male', 'female', 'unknown'][CAST(c_custkey % 3 AS INT) + 1] AS gender,
    lpad(CAST(c_custkey % 50 // 4 * 631 AS VARCHAR), 5, '0') || CASE WHEN c_custkey % 2 = 0 THEN '-' || lpad(CAST(c_custkey % 97 AS VARCHAR), 4, '0') ELSE '' END AS postal,
    CAST(c_custkey % 40 // 4 AS VARCHAR) || [' Main Street', ' Main St.', ' Oak Avenue', ' Oak Ave,'][CAST(c_custkey % 4 AS INT) + 1] AS street, c_mktsegment AS city, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS state,
    CASE WHEN c_custkey % 2 = 0 THEN 'MRN' ELSE 'DL' END AS id_type, CASE WHEN c_custkey % 4 < 2 THEN 'A-' ELSE 'A ' END || (c_custkey // 4) AS id_value,
    CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'T-' ELSE 't' END || (c_custkey // 6) END AS tax,
    CASE WHEN c_custkey % 2 = 0 THEN 'p.' ELSE 'P ' END || (c_custkey // 5) AS doc, ['GB', 'IE'][CAST(c_custkey % 2 AS INT) + 1] AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_ON = "x.k // 8 = y.k // 8 AND x.k < y.k"
_FAMILY = f"CASE WHEN x.family = y.family THEN 1.0 ELSE greatest({_jw('x.family', 'y.family')}, {_lev('x.family', 'y.family')}, CASE WHEN {_sound('x.family')} = {_sound('y.family')} THEN 0.85 ELSE 0.0 END) END"
_GIVEN = f"CASE WHEN x.given = y.given THEN 1.0 WHEN x.nick = y.nick THEN 0.95 ELSE greatest({_jw('x.given', 'y.given')}, {_lev('x.given', 'y.given')}) END"
_PART = lambda c: f"CASE WHEN x.{c} IS NULL AND y.{c} IS NULL THEN 1.0 WHEN x.{c} IS NULL OR y.{c} IS NULL THEN 0.5 ELSE {_jw(f'lower(x.{c})', f'lower(y.{c})')} END"
_NAMES = f"nm AS (SELECT x.k AS a, y.k AS b, {_FAMILY} AS family, {_GIVEN} AS given, {_PART('prefix')} AS prefix, {_PART('suffix')} AS suffix FROM per x JOIN per y ON {_ON})"
_NAME = "0.5 * family + 0.4 * given + 0.1 * ((prefix + suffix) / 2)"
_PLAIN_ID = lambda x: f"regexp_replace({x}, '[- ]', '', 'g')"
_ID = f"CASE WHEN x.id_type <> y.id_type THEN 0.0 WHEN x.id_value = y.id_value THEN 1.0 WHEN {_PLAIN_ID('x.id_value')} = {_PLAIN_ID('y.id_value')} THEN 0.98 ELSE 0.0 END"
_PLAIN_TAX = lambda x: f"lower(regexp_replace({x}, '[^0-9A-Za-z]', '', 'g'))"
_TAX = f"CASE WHEN {_PLAIN_TAX('x.tax')} <> '' AND {_PLAIN_TAX('x.tax')} = {_PLAIN_TAX('y.tax')} THEN 1.0 ELSE 0.0 END"
_PLAIN_DOC = lambda x: f"regexp_replace(upper(trim({x})), '[-. ]', '', 'g')"
_DOC = f"CASE WHEN {_PLAIN_DOC('x.doc')} = {_PLAIN_DOC('y.doc')} THEN CASE WHEN x.country = y.country THEN 1.0 ELSE 0.95 END ELSE 0.0 END"
_SEX = "CASE WHEN x.gender = 'unknown' OR y.gender = 'unknown' THEN 0.5 WHEN x.gender = y.gender THEN 1.0 ELSE 0.0 END"
_DOB = """CASE WHEN x.birth IS NULL AND y.birth IS NULL THEN 0.5 WHEN x.birth IS NULL OR y.birth IS NULL THEN 0.0 WHEN x.birth = y.birth THEN 1.0
    WHEN year(x.birth) = year(y.birth) AND month(x.birth) = month(y.birth) AND abs(x.birth - y.birth) <= 1 THEN 0.95 WHEN year(x.birth) = year(y.birth) AND month(x.birth) = day(y.birth) AND day(x.birth) = month(y.birth) THEN 0.9
    WHEN year(x.birth) = year(y.birth) AND month(x.birth) = month(y.birth) THEN 0.85 WHEN year(x.birth) = year(y.birth) AND day(x.birth) = day(y.birth) THEN 0.8
    WHEN abs(year(x.birth) - year(y.birth)) <= 1 AND month(x.birth) = month(y.birth) AND day(x.birth) = day(y.birth) THEN 0.8 WHEN year(x.birth) = year(y.birth) THEN 0.5 ELSE 0.0 END"""
_SWAP = "CASE WHEN x.birth = y.birth THEN 1.0 WHEN year(x.birth) = year(y.birth) AND day(x.birth) = month(y.birth) AND month(x.birth) = day(y.birth) THEN 0.5 ELSE 0.0 END"
_STREET = lambda x: "translate(" + "replace(" * 8 + f"lower(trim({x}))" + "".join(f", '{w}', '{v}')" for w, v in S.STREET_WORDS) + ", '.,', '')"
_PLACES = """pl AS (SELECT s_suppkey AS k, lower(n_name) AS name, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey // 4 * 37 % 180 - 90 AS DOUBLE) END AS lat, CAST(s_suppkey % 4 / 100 AS DOUBLE) AS lon, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 2 END AS kind,
    CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey // 3 END AS gln, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey // 2 END AS other_id FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_METRES = "2 * 6371000.0 * asin(least(sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)), 1.0))"
_THINGS = """th AS (SELECT p_partkey AS k, p_name AS name, p_type AS description, CASE WHEN p_partkey % 2 = 0 THEN 'https://' ELSE 'HTTP://' END || 'ex' || (p_partkey // 4) || '.org/' || (p_partkey // 2) || CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '' END AS url,
    CASE WHEN p_partkey % 4 > 0 THEN 'isbn' || (p_partkey // 7) END AS isbn, CASE WHEN p_partkey % 3 > 0 THEN 'sku' || (p_partkey // 2) END AS sku FROM part)"""
_URL = "CASE WHEN x.k // 2 = y.k // 2 THEN 1.0 WHEN x.k // 4 = y.k // 4 THEN 0.75 ELSE 0.0 END"
_DIGIT = lambda i: f"CAST(substr(t, {i}, 1) AS INT)"


def _sum(weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * {_DIGIT(i + 1)}" for i, w in enumerate(weights)) + ")"


def _luhn(n: int) -> str:
    return "(" + " + ".join(f"(CASE WHEN 2 * {_DIGIT(i)} > 9 THEN 2 * {_DIGIT(i)} - 9 ELSE 2 * {_DIGIT(i)} END)" if (n - i) % 2 else _DIGIT(i) for i in range(1, n + 1)) + ") % 10 = 0"


def _less(total: str) -> str:
    """0 for a remainder below two, else eleven less it."""
    return f"CASE WHEN {total} % 11 < 2 THEN 0 ELSE 11 - {total} % 11 END"


_CASCADE = f"CASE WHEN {_sum([1, 2, 3, 4, 5, 6, 7, 8, 9, 1])} % 11 < 10 THEN {_sum([1, 2, 3, 4, 5, 6, 7, 8, 9, 1])} % 11 ELSE {_sum([3, 4, 5, 6, 7, 8, 9, 1, 2, 3])} % 11 % 10 END = {_DIGIT(11)}"
_SCHEMES = {
    "nhs": (10, f"CASE WHEN 11 - {_sum([10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11 = 11 THEN 0 ELSE 11 - {_sum([10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11 END = {_DIGIT(10)}"),
    "us_ssn": (9, "substr(t, 1, 3) NOT IN ('000', '666') AND substr(t, 1, 1) <> '9' AND substr(t, 4, 2) <> '00' AND substr(t, 6, 4) <> '0000'"),
    "nl_bsn": (9, f"{_sum([9, 8, 7, 6, 5, 4, 3, 2, -1])} % 11 = 0 AND t <> '000000000'"),
    "se_personnummer": (10, _luhn(10)),
    "bg_egn": (10, f"{_sum([2, 4, 8, 5, 10, 9, 7, 3, 6])} % 11 % 10 = {_DIGIT(10)}"),
    "cz_rc": (10, "CAST(t AS BIGINT) % 11 = 0"),
    "ee_ik": (11, _CASCADE), "lt_ak": (11, _CASCADE),
    "pl_pesel": (11, f"(10 - {_sum([1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = {_DIGIT(11)}"),
    "pl_nip": (10, f"{_sum([6, 5, 7, 2, 3, 4, 5, 6, 7])} % 11 = {_DIGIT(10)}"),
    "pt_nif": (9, f"{_less(_sum([9, 8, 7, 6, 5, 4, 3, 2]))} = {_DIGIT(9)}"),
    "jp_my_number": (12, f"{_less(_sum([6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]))} = {_DIGIT(12)}"),
    "lv_pk": (11, f"(1101 - {_sum([1, 6, 3, 7, 9, 10, 5, 8, 4, 2])}) % 11 % 10 = {_DIGIT(11)}"),
    "be_nn": (11, "97 - CAST(substr(t, 1, 9) AS BIGINT) % 97 = CAST(substr(t, 10, 2) AS INT) OR 97 - (2000000000 + CAST(substr(t, 1, 9) AS BIGINT)) % 97 = CAST(substr(t, 10, 2) AS INT)"),
    "br_cpf": (11, f"{_less(_sum([10, 9, 8, 7, 6, 5, 4, 3, 2]))} = {_DIGIT(10)} AND {_less(_sum([11, 10, 9, 8, 7, 6, 5, 4, 3, 2]))} = {_DIGIT(11)} AND t <> repeat(substr(t, 1, 1), 11)"),
    "dk_cpr": (10, "TRUE"),
}

ORACLE = {
    "name_scores": f"WITH {_PER}, {_NAMES} SELECT a, b, round(family, 9) AS family, round(given, 9) AS given, round(prefix, 9) AS prefix, round(suffix, 9) AS suffix, round({_NAME}, 9) AS name FROM nm",
    "combined_names": f"""
        WITH {_PER}, c AS (SELECT x.k AS a, y.k AS b, 0.7 * {_jw('x.given', 'y.given')} + 0.3 * {_lev('x.given', 'y.given')} AS s, x.nick = y.nick AS nick FROM per x JOIN per y ON {_ON})
        SELECT a, b, round(s, 9) AS combined, round(CASE WHEN nick THEN greatest(s, 0.9) ELSE s END, 9) AS lifted FROM c""",
    "address_scores": f"""
        WITH {_PER}, s AS (SELECT x.k AS a, y.k AS b, {_postal('x.postal', 'y.postal')} AS postal, {_jw(_STREET('x.street'), _STREET('y.street'))} AS street, CASE WHEN lower(x.city) = lower(y.city) THEN 1.0 ELSE {_jw('lower(x.city)', 'lower(y.city)')} END AS city,
            CAST(x.state = y.state AS DOUBLE) AS state FROM per x JOIN per y ON {_ON})
        SELECT a, b, round(CAST(postal AS DOUBLE), 9) AS postal, round(street, 9) AS street, round(postal * 0.3 + city * 0.2 + coalesce(state, 0) * 0.2 + street * 0.3, 9) AS fixed,
               round({_mean(('postal', 0.30), ('city', 0.25), ('street', 0.25), ('state', 0.10))}, 9) AS present FROM s""",
    "identifier_scores": f"""
        WITH {_PER} SELECT x.k AS a, y.k AS b, CAST({_SEX} AS DOUBLE) AS gender, CAST({_ID} AS DOUBLE) AS identifier, CAST({_TAX} AS DOUBLE) AS tax, CAST({_DOC} AS DOUBLE) AS document,
            CAST(greatest({', '.join(_postal(p, q) for p in ('x.postal', 'reverse(x.postal)') for q in ('y.postal', 'reverse(y.postal)'))}) AS DOUBLE) AS postal FROM per x JOIN per y ON {_ON}""",
    "person_scores": f"""
        WITH {_PER}, {_NAMES}, nw AS (SELECT a, b, {_NAME} AS name FROM nm), s AS (SELECT a, b, nw.name, {_DOB} AS dob, {_SEX} AS sex, {_postal('x.postal', 'y.postal')} AS address, {_ID} AS id, {_TAX} AS tax, {_DOC} AS doc, coalesce({_SWAP}, -1) AS swapped
            FROM nw JOIN per x ON nw.a = x.k JOIN per y ON nw.b = y.k), t AS (SELECT *, name * 0.30 + dob * 0.25 + sex * 0.10 + address * 0.10 + id * 0.10 + tax * 0.10 + doc * 0.05 AS total FROM s)
        SELECT a, b, round(CASE WHEN tax >= 1 THEN 1.0 WHEN doc >= 1 THEN 0.98 ELSE total END, 9) AS probability, round(CASE WHEN tax >= 1 THEN 1.0 WHEN doc >= 1 THEN 0.98 ELSE total END, 9) AS worker,
               round(CASE WHEN tax >= 1 OR id >= 0.98 OR doc >= 1 THEN 1.0 ELSE ((name >= 0.9)::INT + (dob >= 0.95)::INT + (sex >= 1)::INT + (address >= 0.8)::INT) / 4 END, 9) AS rules, CAST(swapped AS DOUBLE) AS swapped,
               coalesce(nullif(concat_ws(', ', CASE WHEN name >= 0.9 THEN 'name' END, CASE WHEN dob >= 0.9 THEN 'DOB' END, CASE WHEN sex >= 0.9 THEN 'gender' END, CASE WHEN address >= 0.8 THEN 'address' END, CASE WHEN id >= 0.95 THEN 'identifier' END,
                                 CASE WHEN tax >= 1 THEN 'tax_id' END, CASE WHEN doc >= 0.95 THEN 'document' END), ''), 'no strong matches') AS summary FROM t""",
    "spec_person_scores": f"""
        WITH {_PER}, s AS (SELECT x.k AS a, y.k AS b, (x.id_type = y.id_type AND x.id_value = y.id_value) AS same, {_lev('x.family', 'y.family')} AS family, CASE WHEN x.birth IS NOT NULL AND y.birth IS NOT NULL THEN {_SWAP} END AS dob,
            CASE WHEN x.gender <> 'unknown' AND y.gender <> 'unknown' THEN CAST(x.gender = y.gender AS DOUBLE) END AS sex, {_sound('x.family')} = {_sound('y.family')} AS sound FROM per x JOIN per y ON {_ON}),
        m AS (SELECT a, b, same, sound, {_mean(('CAST(same AS DOUBLE)', 0.30), ('family', 0.20), ('dob', 0.20), ('sex', 0.05))} AS mean FROM s), t AS (SELECT a, b, same, {_bonus('mean', 'sound')} AS score FROM m)
        SELECT a, b, round(score, 9) AS score, round(CASE WHEN same THEN score ELSE 0.0 END, 9) AS strict FROM t""",
    "place_scores": f"""
        WITH {_PLACES}, s AS (SELECT x.k AS a, y.k AS b, {_lev('x.name', 'y.name')} AS name, 1 / (1 + {_METRES} / 1000) AS geo, CAST(x.kind = y.kind AS DOUBLE) AS kind, CAST(x.other_id = y.other_id AS DOUBLE) AS id, coalesce(x.gln = y.gln, FALSE) AS gln,
            {_sound('x.name')} = {_sound('y.name')} AS sound FROM pl x JOIN pl y ON {_ON}), m AS (SELECT a, b, gln, sound, {_mean(('name', 0.35), ('geo', 0.25), ('kind', 0.10), ('id', 0.10))} AS mean FROM s),
        t AS (SELECT a, b, round(CASE WHEN gln THEN 1.0 ELSE {_bonus('mean', 'sound')} END, 6) AS score FROM m)
        SELECT a, b, score, CASE WHEN score >= 0.95 THEN 'Certain' WHEN score >= 0.8 THEN 'Probable' WHEN score >= 0.6 THEN 'Possible' ELSE 'Unlikely' END AS certainty FROM t""",
    "place_name_shares": f"""
        WITH {_PLACES}, sh AS (SELECT name, count(*) / (SELECT count(*) FROM pl) AS share FROM pl GROUP BY 1),
        s AS (SELECT x.k AS a, y.k AS b, CASE WHEN x.name = y.name THEN share END AS most, {_lev('x.name', 'y.name')} AS v FROM pl x JOIN pl y ON {_ON} JOIN sh ON sh.name = x.name)
        SELECT a, b, round(most, 9) AS share, round(CASE WHEN v >= 0.95 AND most IS NOT NULL THEN log2(0.95 / least(greatest(most, 1e-9), 0.95)) WHEN v >= 0.95 THEN log2(0.95 / 0.005) WHEN v <= 0.6 THEN log2(0.05 / 0.995)
               ELSE log2(0.05 / 0.995) + (log2(0.95 / 0.005) - log2(0.05 / 0.995)) * (v - 0.6) / 0.35 END, 6) AS bits FROM s""",
    "thing_scores": f"""
        WITH {_THINGS}, s AS (SELECT x.k AS a, y.k AS b, {_lev('x.name', 'y.name')} AS name, CAST(x.sku = y.sku AS DOUBLE) AS id, {_lev('x.description', 'y.description')} AS description, {_URL} AS url, coalesce(x.isbn = y.isbn, FALSE) AS same FROM th x JOIN th y ON {_ON})
        SELECT a, b, CAST(url AS DOUBLE) AS url, round(CASE WHEN same THEN 1.0 ELSE {_mean(('name', 0.4), ('id', 0.3), ('description', 0.1), ('url', 0.1))} END, 9) AS score FROM s""",
    "deterministic_rules": f"""
        WITH {_THINGS}, s AS (SELECT x.k AS a, y.k AS b, CASE WHEN x.isbn = y.isbn THEN 'R-0' WHEN x.sku = y.sku THEN 'R-1' WHEN lower(x.url) = lower(y.url) THEN 'R-2' END AS rule FROM th x JOIN th y ON {_ON}) SELECT * FROM s WHERE rule IS NOT NULL""",
    "evidence_tables": "SELECT entity, component, round(log2(m / u), 9) AS agree, round(log2((1 - m) / (1 - u)), 9) AS differ FROM (VALUES "
    + ", ".join(f"('{e}', '{k}', CAST({m!r} AS DOUBLE), CAST({u!r} AS DOUBLE))" for e, t in {"person": E.PERSON, **E.OTHERS}.items() for k, (m, u) in t.items()) + ") AS v(entity, component, m, u)",
    "organization_matches": f"""
        WITH o AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS country, s_suppkey // 2 AS domain, CASE WHEN s_suppkey % 3 > 0 THEN list_distinct([s_suppkey % 4, s_suppkey % 5]) END AS kw FROM supplier),
        s AS (SELECT x.k AS a, y.k AS b, {_lev('x.name', 'y.name')} AS name, CAST(x.domain = y.domain AS DOUBLE) AS url, CAST(x.country = y.country AS DOUBLE) AS country,
              len(list_intersect(x.kw, y.kw)) / (len(x.kw) + len(y.kw) - len(list_intersect(x.kw, y.kw))) AS kw FROM o x JOIN o y ON {_ON}),
        t AS (SELECT a, b, {_mean(('name', 0.35), ('url', 0.15), ('country', 0.10), ('kw', 0.10))} AS score FROM s)
        SELECT a, b, round(score, 9) AS score, score >= 0.85 AS is_default, score >= 0.95 AS is_strict, score >= 0.70 AS is_lenient FROM t""",
    "query_candidates": f"""
        WITH {_PER}, s AS (SELECT x.k, round({_lev('x.given', 'q.given')} * 0.4 + {_lev('x.family', 'q.family')} * 0.4 + {_postal('x.postal', 'q.postal')} * 0.2, 9) AS score FROM per x JOIN per q ON q.k = 8 WHERE x.k <> 8)
        SELECT k, score, CAST(row_number() OVER (ORDER BY score DESC, k) AS INTEGER) AS rank FROM s WHERE score >= 0.5""",
    "identity_suggestions": """
        WITH s AS (SELECT 'person:' || c_custkey AS from_ref, 'worker:' || s_suppkey AS to_ref, round(least(exp(-pow(abs(c_acctbal - s_acctbal) / 50, 2)), 0.99), 9) AS confidence FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 100) = floor(s_acctbal / 100))
        SELECT *, 'same_identity' AS kind, 'matcher_suggested' AS provenance FROM s WHERE confidence >= 0.5 ORDER BY confidence DESC, from_ref, to_ref LIMIT 100""",
    "national_identifiers": "WITH x AS (SELECT CAST(o_orderkey * 982451653 % 1000000000000 AS BIGINT) AS x FROM orders) " + " UNION ALL ".join(
        f"SELECT '{k}' AS scheme, count(*) FILTER ({test}) AS n_valid FROM (SELECT lpad(CAST(x % {10**n} AS VARCHAR), {n}, '0') AS t FROM x)" for k, (n, test) in _SCHEMES.items()),
}
