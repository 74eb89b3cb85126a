"""Golden values and invariants of single operators."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import normalize as N
from tessera.functions import similarity as S
from tessera.operators import disclosure as D
from tessera.operators import evidence as E
from tessera.operators import graph as G
from tessera.operators import intervals as I
from tessera.operators import relational as R
from tessera.operators import variants as V
from tessera.operators.search import parse
from tessera.sources import bulk
from tessera.streaming import events as ST

DAY = I.DAY_MS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_jaro_winkler():
    assert S.jaro_winkler_text("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler_text("", "") == 1 and S.jaro_winkler_text("a", "") == 0


def test_levenshtein_counts_bytes_or_characters(spark):
    assert one(spark, S.levenshtein_bytes(F.lit("José"), F.lit("Jose"))) == pytest.approx(0.8)
    assert one(spark, S.levenshtein(F.lit("José"), F.lit("Jose"))) == pytest.approx(0.75)


def test_soundex_variants(spark):
    assert one(spark, S.soundex_reset(F.lit("Ashcraft"))) == "A226"
    assert one(spark, S.soundex(F.lit("Ashcraft"))) == "A261"
    assert one(spark, S.soundex_reset(F.lit("123"))) == "" and one(spark, S.soundex(F.lit("12"))) is None


def test_names(spark):
    df = spark.createDataFrame([("Bill", "william"), ("Ann", "Ann")], "a string, b string")
    assert [r[0] for r in df.select(S.given_name("a", "b")).collect()] == [0.95, 1.0]


def test_birth_dates(spark):
    rows = [("1980-03-04", "1980-03-04", 1.0), ("1980-03-04", "1980-03-05", 0.95), ("1980-03-04", "1980-04-03", 0.90), (None, None, 0.5), ("1980-03-04", None, 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, w double").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"), "w")
    assert all(r[0] == r[1] for r in df.select(S.birth_date("a", "b"), "w").collect())


def test_check_digits(spark):
    cases = [(N.gs1(F.lit("4006381333931"), 13), True), (N.gs1(F.lit("4006381333932"), 13), False), (N.nhs_number(F.lit("943 476 5919")), True), (N.isbn10(F.lit("0-306-40615-2")), True), (N.issn(F.lit("0378-5955")), True), (N.issn(F.lit("2434-561X")), True), (N.verhoeff(F.lit("2363")), True), (N.verhoeff(F.lit("2364")), False), (N.lei(F.lit("5493001KJTIIGC8Y1R12")), True), (N.gs1(F.lit("x"), 13), False)]
    assert [one(spark, c) for c, _ in cases] == [w for _, w in cases]


def test_normal_forms(spark):
    assert one(spark, N.nfkd_name(F.lit(" Ångström,  O'Neil "))) == "angstrom oneil"
    assert one(spark, N.legal_name(F.lit("acme holdings ltd."))) == "acme holdings" and one(spark, N.legal_name(F.lit("the company"))) == "the company"
    assert one(spark, N.domain(F.lit("https://user@www.Example.org.:80/x"))) == "example.org"
    assert one(spark, N.clean_url(F.lit("HTTP://EXAMPLE.org/#top"))) == "http://example.org"
    assert one(spark, D.mask(F.lit("123-45-6789"))) == "***-**-6789" and one(spark, D.mask(F.lit("abc"))) == "abc"


def test_evidence_bits(spark):
    import math

    assert one(spark, E.bits(F.lit(1.0), 0.95, 0.01)) == pytest.approx(math.log2(95))
    assert one(spark, E.bits(F.lit(0.6), 0.95, 0.01)) == pytest.approx(math.log2(0.05 / 0.99))
    assert one(spark, E.discounted([F.lit(-4.0), F.lit(3.0), F.lit(None).cast("double")])) == pytest.approx(-2.5)
    assert E.merge_groups([{"a", "b"}, {"c"}, {"b", "c"}]) == [{"a", "b", "c"}]
    told = one(spark, E.evidence({"family_name": F.lit(1.0)}, identifiers={"ssn": F.lit(0.0), "nhs": F.lit(1.0)}))
    assert told["strength"] == "Contradicted" and told["contradictions"] == ["identifier:ssn"] and told["fields_compared"] == 2


def test_missing_field_policies(spark):
    parts = [(F.lit(1.0), 0.5), (F.lit(None).cast("double"), 0.5)]
    assert one(spark, S.weighted(*parts)) == 1.0 and one(spark, S.weighted(*parts, renormalize=False)) == 0.5
    assert one(spark, S.weighted((F.lit(None).cast("double"), 1.0))) == 0.0


def test_elapsed_time_is_split_exactly(spark):
    r = random.Random(3)
    rows = [(i, r.choice("abc"), r.choice(["VA", "NNVA", "UNVA", None]), s, s + r.randrange(1, 50)) for i in range(20) for s in (r.randrange(200) for _ in range(8))]
    seg = spark.createDataFrame(rows, "k int, stage string, category string, start_ms long, end_ms long")
    clocks = seg.groupBy("k").agg((F.min("start_ms") - 5).alias("t0"), (F.max("end_ms") + 5).alias("t1"))
    for p in I.elapsed_parts(seg, clocks, "k").collect():
        assert p.va_ms + p.nnva_ms + p.unva_ms + p.unrecorded_ms == p.lead_ms and min(p.va_ms, p.nnva_ms, p.unva_ms, p.unrecorded_ms) >= 0
        mine = {t for x in rows if x[0] == p.k for t in range(x[3], x[4])}
        assert p.lead_ms - p.unrecorded_ms == len(mine)


def test_overlapping_eras():
    eras = lambda *x: [(s, a * DAY, b * DAY) for s, a, b in x]
    assert V.resolve_overlaps(eras(("a", 0, 60), ("b", 20, 100)), 30 * DAY) == eras(("a", 0, 20), ("a+b", 20, 60), ("b", 60, 100))
    assert V.resolve_overlaps(eras(("a", 0, 60), ("b", 50, 100)), 30 * DAY) == eras(("a", 0, 50), ("b", 50, 60), ("b", 60, 100))
    assert V.resolve_overlaps(eras(("a", 0, 100), ("b", 20, 60)), 30 * DAY) == eras(("a", 0, 20), ("a+b", 20, 60), ("a", 60, 100))
    done = V.resolve_overlaps(eras(("a", 0, 90), ("b", 10, 80), ("c", 20, 70)), 30 * DAY)
    assert all(x[2] <= y[1] for x, y in zip(done, done[1:]))


def test_suppression_never_leaves_one_hidden_cell():
    r = random.Random(5)
    for _ in range(200):
        w, h = r.randrange(1, 5), r.randrange(1, 5)
        counts = [r.randrange(0, 20) for _ in range(w * h)]
        parts = [[y * w + x for x in range(w)] for y in range(h)] + [[y * w + x for y in range(h)] for x in range(w)]
        hidden = D.choose_suppressed(counts, parts)
        assert all(not (sum(i in hidden for i in p) == 1 and len(p) > 1) for p in parts)
        assert all(i in hidden for i, n in enumerate(counts) if n < 5)


def test_survival_golden(spark):
    df = spark.createDataFrame([(1, True), (2, True), (2, False), (4, True)], "t int, e boolean")
    assert [(r.t, r.at_risk, r.survival) for r in I.kaplan_meier(df, "t", "e").orderBy("t").collect()] == [(1, 4, 0.75), (2, 3, 0.5), (4, 1, 0.0)]


def test_chain(spark):
    rows = spark.createDataFrame([("l", 1, "a"), ("l", 2, "b"), ("l", 3, "c")], "log string, seq int, text string").withColumn("prev_hash", F.lit(None).cast("string"))
    h1 = one(spark, F.sha2(F.concat_ws(D.SEPARATOR, F.lit(""), F.lit("a")).cast("binary"), 256))
    h2 = one(spark, F.sha2(F.concat_ws(D.SEPARATOR, F.lit(h1), F.lit("b")).cast("binary"), 256))
    h3 = one(spark, F.sha2(F.concat_ws(D.SEPARATOR, F.lit(h2), F.lit("c")).cast("binary"), 256))
    chain = spark.createDataFrame([("l", 1, "a", None, h1), ("l", 2, "b", h1, h2), ("l", 3, "c", h2, h3)], "log string, seq int, text string, prev_hash string, hash string")
    assert D.chain_summary(D.verify_chain(chain, "log", "seq", "text"), "log", "seq").head()["holds"]
    bad = D.chain_summary(D.verify_chain(chain.withColumn("text", F.when(F.col("seq") == 2, "x").otherwise(F.col("text"))), "log", "seq", "text"), "log", "seq").head()
    assert not bad["holds"] and bad["n_changed"] == 1 and bad["head"] == h3
    assert rows.count() == 3


def test_identity_closure_and_merge(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101)], "a long, b long")
    got = {r.ref: r.identity for r in G.identity_closure(pairs).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {100: 100, 101: 100}
    rec = spark.createDataFrame([("a", "A", ["x"], None), ("b", "B", ["y", "x"], 5), ("c", "C", None, 7), ("d", "D", [], 1)], "id string, name string, tags array<string>, n int")
    out = {r.id: r for r in G.merge_fold(rec, spark.createDataFrame([("a", "b"), ("b", "c")], "main string, duplicate string"), "id", "name", ["tags"], ["n"]).collect()}
    assert set(out) == {"a", "d"} and out["a"].tags == ["x", "y"] and out["a"].n == 5 and out["a"].alternate_names == ["B", "C"]


def test_reviews(spark):
    queue = spark.createDataFrame([(1, 2, 0.8, "rejected"), (1, 3, 0.99, "automerged")], "a int, b int, score double, status string")
    scan = spark.createDataFrame([(2, 1, 0.9, "pending"), (1, 3, 0.9, "pending"), (4, 5, 0.97, "automerged")], "a int, b int, score double, status string")
    assert sorted(tuple(r) for r in R.refresh_reviews(queue, scan).collect()) == [(1, 2, 0.9, "rejected"), (1, 3, 0.9, "pending"), (4, 5, 0.97, "automerged")]


def test_query_parser():
    assert parse("+alpha beta NOT gamma -delta") == [("must", "alpha"), ("should", "beta"), ("not", "gamma"), ("not", "delta")]
    assert parse("alpha AND beta") == [("must", "alpha"), ("must", "beta")] and parse("  ") == []


STRINGS = T.ArrayType(T.StringType())
NAME = T.StructType([T.StructField("family", T.StringType()), T.StructField("given", STRINGS)])
SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("tags", STRINGS), T.StructField("name", NAME)])


def test_bulk_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x", "y"], ("Ö,\"q\"", ["g"])), ("b", None, None, None)], SCHEMA)
    for kind in ("jsonl", "csv", "tsv"):
        bulk.export(df, f"{tmp_path}/{kind}", kind)
        back = bulk.read(spark, f"{tmp_path}/{kind}", kind, SCHEMA)
        assert back.where("__error IS NOT NULL").count() == 0
        assert {r.id: (r.n, r.tags) for r in back.collect()} == {"a": (1, ["x", "y"]), "b": (None, None)}
        assert back.where("id = 'a'").head()["name"]["family"] == "Ö,\"q\""
    with pytest.raises(ValueError):
        bulk.read(spark, "x", "parquet", SCHEMA)


def test_bad_rows_are_reported(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"a","n":1}\n\n{"id":\n{"id":"b"}\r\n')
    rows = bulk.read(spark, f"{tmp_path}/x.jsonl", "jsonl", SCHEMA)
    assert rows.count() == 3 and bulk.error_report(rows).count() == 1
    (tmp_path / "x.csv").write_text('n,id,extra\n1,a,z\nq,b,z\n')
    rows = bulk.read(spark, f"{tmp_path}/x.csv", "csv", SCHEMA)
    assert bulk.error_report(rows).head()["field"] == "n"
    planned = bulk.plan_import(rows, spark.createDataFrame([("a",)], "id string"), "id")
    assert tuple(bulk.import_counts(planned).head()) == (2, 0, 1, 1, 0)


def test_late_events_change_nothing(spark):
    e = spark.createDataFrame([("p", "1", "created", 1), ("p", "1", "deleted", 3), ("p", "1", "updated", 2)], "entity string, pid string, kind string, seq long")
    empty = spark.createDataFrame([], "ref string, alive boolean, last_seq long")
    once = ST.apply_presence(empty, e)
    assert [tuple(r) for r in once.collect()] == [("p:1", False, 3)]
    assert [tuple(r) for r in ST.apply_presence(once, e).collect()] == [("p:1", False, 3)]


def test_envelopes(spark):
    raw = spark.createDataFrame([('{"event_id":"1","kind":"created","entity":"p","pid":"x","seq":1}',), ("{",), ('{"event_id":"2","kind":"odd"}',), ('{"event_id":"3","kind":"merged","schema_version":9}',)], "value string")
    assert [r.event_id for r in ST.envelopes(raw).collect()] == ["1"]


def test_rate_limit_counts_what_it_allowed(spark):
    import random

    r = random.Random(2)
    rows = [(r.randrange(4), i, r.randrange(500)) for i in range(300)]
    got = {x.id: x.allowed for x in D.rate_limited(spark.createDataFrame(rows, "who long, id long, at long"), "who", "at", "id", 3, 60).collect()}
    for who in range(4):
        recent = []
        for w, i, at in sorted((x for x in rows if x[0] == who), key=lambda x: (x[2], x[1])):
            recent = [t for t in recent if t > at - 60]
            assert got[i] == (len(recent) < 3)
            if got[i]:
                recent.append(at)


def test_drain_stops_at_the_first_failure(spark):
    box = spark.createDataFrame([(i, i % 3, None) for i in range(10)], "id long, pid long, published_at timestamp")
    sent = ST.drain(box, lambda todo: todo.select("id", (F.col("id") != 6).alias("ok")), "2024-01-01 00:00:00")
    assert sorted(r.id for r in sent.where("published_at IS NOT NULL").collect()) == [0, 1, 2, 3, 4, 5]
    assert ST.drain(sent, lambda todo: todo.select("id", F.lit(True).alias("ok")), "2024-01-02 00:00:00").where("published_at IS NULL").count() == 0


def test_national_identifiers(spark):
    from tessera.functions import identifiers as I

    good = {"nhs": "9434765919", "us_ssn": "123456789", "nl_bsn": "111222333", "se_personnummer": "8112189876", "bg_egn": "7523169263", "ee_ik": "37605030299", "pl_pesel": "44051401359", "pt_nif": "123456789", "be_nn": "85073003328", "br_cpf": "11144477735"}
    one = spark.range(1)
    for scheme, text in good.items():
        n, check = I.NUMERIC[scheme]
        bad = text[:-1] + str((int(text[-1]) + 1) % 10)
        told = one.select(check(F.lit(text)).alias("good"), check(F.lit(bad)).alias("bad"), check(F.lit("x")).alias("odd")).head()
        assert told.good and not told.odd and (not told.bad or scheme == "us_ssn"), scheme
    told = one.select(I.spanish(F.lit("12345678Z")), I.spanish(F.lit("X1234567L")), I.spanish(F.lit("12345678A")), I.finnish(F.lit("131052-308T")), I.finnish(F.lit("131052-308U")), I.french(F.lit("255081416802538")), I.french(F.lit("255081416802539"))).head()
    assert tuple(told) == (True, True, False, True, False, True, False)


def test_matcher_settings():
    from tessera.operators import evidence as E

    assert E.config_problems(E.WEIGHTS["organization"], 0.85) == [] and E.config_problems({"a": -1.0, "b": float("nan")}, 1.5, 0) == ["weight a", "weight b", "threshold", "proof_bits"]


def test_pareto_over_many_keys(spark):
    from tessera.operators.rollups import pareto

    rows = [(f"k{i:04}", (i * 7919) % 50 + 1) for i in range(500)]
    got = sorted((r.rank, r.key, r.n, r.cumulative) for r in pareto(spark.createDataFrame(rows, "key string, n long"), "key").collect())
    want, upto, total = sorted(rows, key=lambda x: (-x[1], x[0])), 0, sum(n for _, n in rows)
    for i, ((rank, key, n, cumulative), (k, m)) in enumerate(zip(got, want)):
        upto += m
        assert (rank, key, n) == (i + 1, k, m) and abs(cumulative - upto / total) < 1e-12


def test_rules_refuse_what_they_do_not_know(spark):
    from tessera.operators import rules

    known = {"stage": {"a", "b"}}
    assert rules.parse_rule("stage:a", known) == ("stage", "a")
    for text in ("stage", "stage:", "colour:red", "stage:c"):
        with pytest.raises(ValueError):
            rules.parse_rule(text, known)
    df = spark.createDataFrame([(1, ["a", "b"], "home"), (2, ["a"], None), (3, None, "home")], "id int, stages array<string>, setting string")
    of = lambda *x: sorted(r.id for r in df.where(rules.matches(*x)).collect())
    assert of([], []) == [1, 2, 3] and of(["stage:a"], ["setting:home"]) == [2] and of([], ["stage:b"]) == [2, 3]
