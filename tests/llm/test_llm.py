"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tests.oracle import connect, differing  # noqa: E402
from tessera.llm import bpe, chat, content_store, langid, lattice, line_dedup, media, mixing, mtree, near_dup, queries, units  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur " * 3000
ODD = [
    (1, None, "en", "src0"), (2, "", "en", None), (3, " \n\t ", None, "src1"), (4, "Hello world,  this is a <|endoftext|> test\r\n\nof 12 things 🎉 and ǅ.", "en", "src0"),
    (5, LONG, "en", "src1"), (6, LONG, "en", "src0"), (6, LONG, "en", "src0"), (None, "no id here", "de", "src0"), (None, None, None, None), (9, "a" * 4000, None, "src2"),
    (10, "one two three", "fr", "src2"), (11, "one two three", "fr", "src2"), (12, "!!! 123", "fr", "src2"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, word string, n int, `rank` int, __x int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns that clash with inner names."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def order(r):
    return (r[0] is not None, r[0] or 0)


def test_units_of_every_script_are_short_and_few():
    """Texts without Latin letters are cut too, and a memo holds its bound whatever it reads."""
    r = random.Random(3)
    scripts = ("абвгдежзиклмнопрст", "αβγδεζηθικλμν", "אבגדהוזחט", "漢字仮名交文章")
    texts = [" ".join("".join(r.choice(s) for _ in range(r.randrange(1, 8))) for _ in range(300)) for s in scripts for _ in range(20)]
    assert all(max(map(len, units.cut(t))) <= 8 for t in texts)
    for space in "\u0085\u00a0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000\ufeff\t\x1c":
        assert units.cut(f"a{space} b") == [f"a{space} b"] and units.cut(f"a {space}b") == [f"a {space}b"]
    t = bpe.Transducer(queries.tokenizer_path())
    before, units.MEMO = units.MEMO, 50_000
    try:
        t.encode(texts)
        t.encode(["x" * 500 + " y"])
        assert t.memo.size < 50_000 and all(len(u) <= units.SHORT for u in t.memo.known)
    finally:
        units.MEMO = before


def test_memo_encodes_each_unit_once_within_its_bound():
    asked = Counter()

    def encode(own, joined):
        asked.update(own)
        return np.array([zlib.crc32(u) for u in own], np.uint32), np.ones(len(own), np.int64)

    memo, words = units.UnitMemo(encode), [f" w{i:07d}" for i in range(400_000)]
    texts = ["x" + "".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    want = [[zlib.crc32(u.encode()) for u in ("x", *words[i : i + 1000])] for i in range(0, len(words), 1000)]
    assert memo.encode(texts) == want and memo.encode(texts) == want
    assert set(asked.values()) == {1} and len(asked) == 400_001 == len(memo.known) and memo.size < units.MEMO


def test_memo_tells_units_apart_whose_prints_are_equal(library, monkeypatch):
    texts = ["one two three", "one  two\n\nthree", " three two one four", "é\0 é\0\0 " + "long" * 40 + " x", "", LONG] * 2
    for same in (lambda self: np.zeros(len(self.at), np.uint64), lambda self: self.length.astype(np.uint64)):
        monkeypatch.setattr(units.Spans, "prints", same)
        memo = content_store.library_encoder(queries.tokenizer_path(), str(same))
        assert memo.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_units_join_to_the_text():
    for text in ("a b\nc", " x", "a  b", "", "é ü\n\nz", LONG):
        assert "".join(units.cut(text)) == text


@pytest.mark.parametrize("frame", ["odd", "real"])
def test_content_store(spark, odd, library, frame, tmp_path):
    docs = odd if frame == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=order)
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    got = content_store.content_store(docs, queries.tokenizer_path()).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    got = sorted(got, key=lambda r: r.start)
    assert [order(r) for r in got] == [order(r) for r in rows]
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist() if frame == "real" else sum(r.n_tokens for r in got) == sum(map(len, ids))
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in zip(rows, ids))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_store_reads_back_and_detects_damage(spark, library, tmp_path):
    docs = spark.createDataFrame([(1, "some words here"), (2, LONG)], "doc_id long, text string")
    path = f"file://{tmp_path}/s"
    content_store.write_store(docs, path, queries.tokenizer_path(), 2)
    back = {r.doc_id: r.ids for r in content_store.read_store(spark, path).collect()}
    assert back == {d: library.encode(t, add_special_tokens=False).ids + [2] for d, t in ((1, "some words here"), (2, LONG))}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count() < spark.read.parquet(f"{path}/recipes").select(F.explode("chunks")).count()
    first = chunks.orderBy("hash").head()["hash"]
    bad = chunks.withColumn("payload", F.when(F.col("hash") == F.lit(first), F.lit(bytes(2)).cast("binary")).otherwise(F.col("payload"))).collect()
    spark.createDataFrame(bad, chunks.schema).write.mode("overwrite").parquet(f"{path}/chunks")
    assert not all(r.intact for r in content_store.store_digests(spark, path).collect())


def test_store_stages_no_payload(spark, odd, empty, tmp_path, monkeypatch):
    """Chunks and recipes come from one pass, nothing else stays, and no memo outlives its store."""

    def refused(*_):
        raise AssertionError("a staged table")

    monkeypatch.setattr(content_store, "work_path", refused)
    for name, docs in (("odd", odd), ("empty", empty)):
        content_store.write_store(docs, f"file://{tmp_path}/{name}", queries.tokenizer_path(), 2)
        assert sorted(p.name for p in (tmp_path / name).iterdir()) == ["chunks", "manifest", "recipes", "shards"]
        assert spark.read.parquet(f"file://{tmp_path}/{name}/chunks").columns == ["hash", "n_ids", "payload"]
        got = content_store.store_digests(spark, f"file://{tmp_path}/{name}").collect()
        assert len(got) == docs.count() and all(r.intact for r in got)
    assert content_store.library_encoder(queries.tokenizer_path(), "a") is not content_store.library_encoder(queries.tokenizer_path(), "b")


def test_chunks_of_many_texts_are_those_of_each(library):
    texts = ["", "a", LONG, "word " * 31, "word " * 32, *(LONG[i:] for i in range(0, 90, 7)), None]
    batch = pa.RecordBatch.from_pydict({"row": [*range(len(texts))], "doc_id": [None, -5, *range(len(texts) - 2)], "text": pa.array(texts, pa.string())})
    out = content_store._encode(content_store.library_encoder(queries.tokenizer_path(), "many"), batch, 2, "<u2").to_pylist()
    want = []
    for t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u2")
        cuts = content_store.cut_points(ids)
        want += [ids[a:b].tobytes() for a, b in zip([0, *cuts], cuts)]
    assert [r["payload"] for r in out if not r["doc"]] == want and sum(r["doc"] for r in out) == len(texts)


def test_chunks_resist_insertion():
    ids = np.random.default_rng(1).integers(0, 50_000, 20_000)
    pieces = lambda x: {hashlib.sha256(x[a:b].tobytes()).digest() for a, b in zip([0, *content_store.cut_points(x)], content_store.cut_points(x))}
    a, b = pieces(ids), pieces(np.insert(ids, 5000, 7))
    assert len(a - b) <= 3 and max(np.diff([0, *content_store.cut_points(ids)])) <= content_store.MOST


def test_crc_of_parts():
    a, b = b"some bytes", b"and others" * 9
    moved = content_store.crc_moved(np.array([zlib.crc32(a), zlib.crc32(b)]), np.array([len(b), 0]))
    assert int(moved[0] ^ moved[1]) == zlib.crc32(a + b)


def test_crc_of_long_parts():
    for n in (0, 1, 2, 255, 4096, 100_003):
        (moved,) = content_store.crc_moved(np.array([zlib.crc32(b"start")]), np.array([n]))
        assert int(moved) == zlib.crc32(b"start" + bytes(n)) ^ zlib.crc32(bytes(n))


def test_media(spark, odd):
    rows = media.media_digests(odd).collect()
    assert len(rows) == len(ODD)
    for r, w in zip(sorted(rows, key=lambda r: (order(r), r.n_bytes)), sorted(ODD, key=lambda r: (order(r), len((r[1] or "").encode())))):
        raw = (w[1] or "").encode()
        pad = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))


def test_containers():
    payload = bytes(range(256)) * 3 * 75
    file = media.write_track(payload)
    (t,) = media.tracks(file)
    assert media.payload_of(file, t) == payload and t["duration"] == len(payload) and t["codec"] == "raw " and t["sync"][:2].tolist() == [0, 25]
    assert "/moov/trak/mdia/minf/stbl/stsz" in [p for p, *_ in media.walk(file)]
    assert "error" in media.describe(file[:-5]) and "error" in media.describe(file[:100]) and media.describe(None) == {} and media.describe(b"") == {"tracks": []}
    for i in range(0, 700, 7):
        media.describe(file[:i] + b"\xff" + file[i + 1 :])


def test_media_column(spark):
    df = spark.createDataFrame([(1, bytearray(media.write_track(bytes(384)))), (2, None), (3, bytearray(b"junk-junk-junk"))], "id int, f binary")
    got = {r.id: r.media_info for r in media.media_columns(df, "f").collect()}
    assert got[1].tracks[0].n_samples == 2 and got[1].tracks[0].keyframes[0].size == 192 and got[3].error and not got[2].tracks


def test_chat(spark):
    con = connect(SF)
    assert differing(con, queries.ORACLE["op3_snapshot_collapse"], queries.QUERIES["op3_snapshot_collapse"](spark, SF))[1] == 0
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 5, "bot", "yo"), (4, 0, "user", None), (5, 0, "user", ""), (None, 0, None, "<|im_end|>"), (6, 0, "user", "hi"), (6, 1, "bot", "no")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n string")
    got = {r.conv_id: r for r in chat.collapse_and_render(turns).collect()}
    assert set(got) == {1, 4, 5, 6, None} and got[1].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n"
    assert got[None].rendered == "<|im_start|>unknown\n<im_end><|im_end|>\n"
    assert chat.collapse_and_render(turns.limit(0)).count() == 0


def test_chat_ties(spark, tmp_path):
    """Turns of one number come by role and text, as in the query's SQL."""
    r = random.Random(9)
    rows = [(c, r.randrange(2), r.choice(["user", "bot", None]), r.choice(["a", "b", "", None, "word " * 2000])) for c in range(60) for _ in range(r.randrange(1, 4))]
    rows += rows[:10]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    n, off = differing(con, queries.ORACLE["op3_snapshot_collapse"], queries.QUERIES["op3_snapshot_collapse"](spark, str(tmp_path)))
    assert n > 10 and off == 0


def test_top_products(spark):
    assert differing(connect(SF), queries.ORACLE["op4_metric_tree"], queries.QUERIES["op4_metric_tree"](spark, SF))[1] == 0


def test_top_products_of_odd_vectors(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)], "x") for i in range(300)] + [(20, None, "x"), (40, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (None, [1.0] * 6, "x"), (60, [float("nan")] * 6, "x"), (80, [float("inf")] * 6, "x"), (301, [], "x"), (20, [1.0] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = [(i, [int(np.floor(64 * x)) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want = Counter()
    for n, (i, e) in enumerate(good):
        if i % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(e, f)), j) for m, (j, f) in enumerate(good) if m != n))[:20]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    vectors = mtree.quantize(df)
    got = mtree.search(vectors, F.col("vec_id") % 20 == 0, 20)
    assert Counter(map(tuple, got.collect())) == want
    few = mtree.top_inner_products(df.limit(3))
    assert few.count() == 2 and mtree.top_inner_products(df.limit(0)).count() == 0


def pages_of(spark, df, **settings):
    pages, placed, top = mtree.build(mtree.quantize(df), **settings)
    trees = defaultdict(list)
    for n in pages.collect():
        trees[n["tree"]].append(n)
    return trees, top


def test_best_first_computes_fewer_distances(spark):
    """Stored bounds save most products: of clustered vectors in several leaves a query computes far fewer than there are."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 0.01, (500, 8)) for c in r.normal(0, 1, (10, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    trees, top = pages_of(spark, df, capacity=100_000)
    (nodes,) = trees.values()
    nodes = sorted(nodes, key=lambda n: n["node"])
    assert sum(len(n["ids"]) // 8 for n in nodes if n["rows"] is not None) == len(x)
    centers, radius, up = (np.stack([np.frombuffer(n["center"]) for n in nodes]), np.array([n["radius"] for n in nodes]), np.array([n["up"] for n in nodes]))
    kids = [np.array([m["node"] for m in nodes[1:] if m["parent"] == n["node"]], int) for n in nodes]
    leaf = {n["node"]: (np.frombuffer(n["rows"], "<i8"), np.frombuffer(n["ids"], "<i8"), np.frombuffer(n["vectors"], "<f8").reshape(-1, 8), np.frombuffer(n["out"])) for n in nodes if n["rows"] is not None}
    q = np.floor(64 * x)
    shares = []
    for i in range(0, len(x), 250):
        computed = []
        found = mtree._best_first(q[i], -1, None, centers, radius, up, kids, leaf, 5, top, computed)
        shares.append(sum(computed) / len(x))
        assert sorted((s for s, _, _ in found), reverse=True) == np.sort((q @ q[i]).astype(np.int64))[::-1][:5].tolist()
    assert np.mean(shares) < 0.5 and max(shares) < 1.05


def test_large_components_are_searched(spark):
    """Components of a million, of more than 64-bit products hold, and beyond doubles' squares."""
    r = random.Random(6)
    for size in (1e6, 1e12, 1e200):
        rows = [(i, [r.choice([-1, 1]) * size * r.random() for _ in range(4)]) for i in range(100)] + [(100, [3.0, 2.0, 1.0, 0.0]), (101, [1e308, 1.0, 1.0, 1.0])]
        good = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows if i < 101]
        want = Counter()
        for i, e in good:
            if i % 20 == 0:
                score = lambda f: min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(e, f))))  # noqa: E731, B023
                best = sorted((-score(f), j) for j, f in good if j != i)[:20]
                want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
        got = mtree.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert Counter(map(tuple, got.collect())) == want


def test_many_dimensions(spark):
    rows = [(i, [1.0] * (i % 90 + 1)) for i in range(360)]
    got = mtree.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 18 * 3 and all((r.query_id - r.vec_id) % 90 == 0 for r in got)


def words(line):
    return tuple(re.findall(r"[^\x20\x09\x0B-\x0D]+", line))


def edits(a, b):
    """Whether two sequences are one edit apart or equal."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def units_of(w, least=10, chars=20):
    """What an edit changes in a line: its words, its characters, or nothing."""
    return ("words", w) if len(w) >= least else ("chars", " ".join(w)) if len(" ".join(w)) >= chars else None


def brute_lines(rows):
    places = [((d is not None, d or 0), i, words(x)) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if words(x)]
    first, near = {}, {}
    for d, i, w in sorted(places):
        first.setdefault(w, (d, i))
    for kind in ("words", "chars"):
        some = sorted((p, u[1], w) for w, p in first.items() if (u := units_of(w)) and u[0] == kind)
        for k, (p, u, w) in enumerate(some):
            near[w] = next((q for q, v, _ in some[:k] if q < p and edits(v, u)), None)
    return {(d, i): first[w] if (d, i) != first[w] else near.get(w) for d, i, w in places}


def test_line_dedup(spark):
    assert differing(connect(SF), queries.ORACLE["op5_line_dedup"], queries.QUERIES["op5_line_dedup"](spark, SF))[1] == 0


def test_line_dedup_near(spark):
    r = random.Random(7)
    base = [[r.choice("abcdefgh") for _ in range(n)] for n in (10, 11, 12, 40)]
    lines = []
    for _ in range(300):
        w = list(r.choice(base))
        for _ in range(r.randrange(3)):
            k, i = r.randrange(3), r.randrange(len(w))
            w[i : i + (k > 0)] = [r.choice("abxy")] * (k < 2)
        lines.append((" " * r.randrange(3)).join(["", " ".join(w)]))
    short = ["das ist keine lange Zeile", "漢字かな交じりの文には空白がないので一語になる𠀀", "tiny line"]
    for _ in range(120):
        c = list(r.choice(short))
        for _ in range(r.randrange(3)):
            k, i = r.randrange(3), r.randrange(len(c))
            c[i : i + (k > 0)] = [r.choice("ab 漢𠀀")] * (k < 2)
        lines.append("".join(c))
    rows = [(i, "\n".join(lines[i * 6 : i * 6 + 6])) for i in range(70)] + [(None, lines[0]), (80, None), (81, ""), (82, "\n \n")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, first int")
    want = brute_lines(rows)
    got = {((r.doc_id is not None, r.doc_id or 0), r.line_no): r for r in line_dedup.line_decisions(df).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k].kept == (w is None) and (w is None or ((got[k].dup_doc is not None, got[k].dup_doc or 0), got[k].dup_line) == w)
    out = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(df).collect()}
    assert out[80] is None and out[81] == "" and out[82] == "\n \n" and len(out) < len(rows)


def test_line_dedup_of_odd_rows(spark, odd, empty):
    assert line_dedup.line_decisions(empty).count() == 0 and line_dedup.drop_duplicate_lines(empty).count() == 0
    kept = line_dedup.drop_duplicate_lines(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, None, None, 9, 10, 12])


def random_text(r):
    k = r.random()
    if k < 0.4:
        return "".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 0x250), r.randrange(1, 0x3000), 0x1F389, 10, 32])) for _ in range(r.randrange(60)))
    if k < 0.7:
        return "".join(r.choice("abcdeghinorst") for _ in range(r.randrange(1500)))
    return "".join(r.choice([" ", "  ", "\n", "\t", "'s", "the", "<|endoftext|>", "a" * 300, "12", "é"]) for _ in range(40))


def test_transducer_matches_library(library):
    t, r = bpe.Transducer(queries.tokenizer_path()), random.Random(11)
    texts = [random_text(r) for _ in range(300)] + [x[1] for x in ODD if x[1]]
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert t.encode(texts) == ids
    assert [t.decode(i) for i in ids] == [library.decode(i, skip_special_tokens=False) for i in ids]
    broken = [[i] for i in range(0, 50_000, 997)]
    assert [t.decode(i) for i in broken] == [library.decode(i, skip_special_tokens=False) for i in broken]


def test_stream_keeps_a_bounded_window():
    v = bpe.Vocabulary(queries.tokenizer_path())
    e, text = bpe.Encoder(v), "".join(random.Random(1).choice("abcdefghij") for _ in range(20_000)).encode()
    out = [t for i in range(0, len(text), 100) for t in e.feed(text[i : i + 100])]
    assert len(e.bytes) < v.lookahead + v.longest + bpe.STEP + 100
    assert b"".join(out + e.close()) == text


def test_bpe_query(spark, odd, empty, library):
    got = Counter(tuple(r) for r in bpe.bpe_digests(odd, queries.tokenizer_path()).collect())
    want = Counter()
    for d, t, *_ in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want and bpe.bpe_digests(empty, queries.tokenizer_path()).count() == 0


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    told = langid.predicted_languages(odd).collect()
    assert len(told) == len(ODD) and Counter(r.doc_id for r in told if r.lang_pred == "und") == Counter([1, 2, 3, None, 12])
    assert langid.predicted_languages(empty).count() == 0
    assert langid.keep_known_language(odd).columns == odd.columns


def test_sample_is_exact_where_keys_tie(spark):
    """One doc_id in all rows: its rows tie, and no more than the sample reaches the driver."""
    rows = [(7, f"some words {i % 5} here", "en") for i in range(300)] + [(7, "quelques mots ici", "fr")] * 50
    seen = []
    train = langid.train_ftrl
    langid.train_ftrl = lambda rows, *a: seen.append(len(rows)) or train(rows, *a)
    try:
        model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 40)
    finally:
        langid.train_ftrl = train
    assert seen == [32] and set(model[0]) <= {"en", "fr"}


def test_ngrams_at_the_border_of_a_step():
    letters, text = langid.letter_table(), "the quick  brown-fox jumps " * 40
    whole = langid.features(text, letters)
    for step in (1, 2, 3, 7, 100):
        before, langid._STEP = langid._STEP, step
        try:
            at, n = langid.features(text, letters)
        finally:
            langid._STEP = before
        assert at.tolist() == whole[0].tolist() and n.tolist() == whole[1].tolist()


def test_ftrl_equals_a_plain_one():
    """The same weights as follow-the-regularised-leader written out for each coordinate and class."""
    r = np.random.default_rng(8)
    rows = [(np.sort(r.choice(40, 5, replace=False)), r.random(5), int(r.integers(3))) for _ in range(60)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        if i != langid.DIM and abs(z[i, c]) <= langid.L1:
            return 0.0
        shrunk = z[i, c] - (np.sign(z[i, c]) * langid.L1 if i != langid.DIM else 0)
        return -shrunk / ((langid.BETA + n[i, c] ** 0.5) / langid.ALPHA + (langid.L2 if i != langid.DIM else 0))

    for _ in range(langid.EPOCHS):
        for at, x, y in rows:
            some = [*zip(at.tolist(), x.tolist()), (langid.DIM, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in some for c in range(3)}
            s = np.exp([sum(v * w[i, c] for i, v in some) for c in range(3)])
            for c in range(3):
                for i, v in some:
                    g = v * (s[c] / s.sum() - (c == y))
                    sigma = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / langid.ALPHA
                    z[i, c] += g - sigma * w[i, c]
                    n[i, c] += g * g
    w, b = langid.train_ftrl(rows, 3)
    assert np.allclose(w[:40], [[weight(i, c) for c in range(3)] for i in range(40)]) and np.allclose(b, [weight(langid.DIM, c) for c in range(3)])


def test_temperature_and_sparsity():
    r = np.random.default_rng(0)
    rows = [(np.array([y, 10 + int(r.integers(50))]), np.array([0.7, 0.7]), int(y)) for y in r.integers(0, 3, 300)]
    w, b = langid.train_ftrl(rows, 3)
    assert all((x @ w[at] + b).argmax() == y for at, x, y in rows) and (w != 0).mean() < 0.01
    logits = r.normal(size=(2000, 3))
    y = np.array([r.choice(3, p=np.exp(z) / np.exp(z).sum()) for z in logits])
    assert langid.temperature(logits * 3, y) == pytest.approx(3, rel=0.2)


def brute_near(rows, width, percent=80):
    sets = defaultdict(set)
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        if w and d is not None:
            sets[d] |= {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}
    up = {d: d for d, _ in rows if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: find(d) for d in up}


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_near([(r.doc_id, r.text) for r in docs.collect()], 4)
    got = near_dup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_dense_group(spark):
    """Chains and a large group, in which many links don't go to the pivot."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(8)):
            w[r.randrange(60)] = f"z{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:i] + [f"c{i}"] * 3)) for i in range(30, 60)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1)
    assert {x.doc_id: x.component_id for x in got.collect()} == brute_near(rows, 1)


def test_near_duplicates_below_the_threshold(spark):
    """A group of 2,000 that is alike but not enough is searched without a pair of each two, and true links in it are found."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(2000):
        w = list(base)
        for k in r.sample(range(100), 13):
            w[k] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(5000 + i, rows[i][1].replace("w50", "other").replace("w51", "more")) for i in range(0, 2000, 100)]
    seen = {}
    write = near_dup.Tables.write

    def counted(self, name, df):
        out = write(self, name, df)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    near_dup.Tables.write = counted
    try:
        got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    finally:
        near_dup.Tables.write = write
    assert got == brute_near(rows, 1) and sum(a != b for a, b in got.items()) == 20
    assert seen.get("pairs", 0) + seen.get("met", 0) < 40 * len(rows) < len(rows) ** 2 / 20


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 9: 9, 10: 10, 11: 10, 12: 12}
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.keep_one_of_each(empty).columns == odd.columns


def test_posterior_bounds():
    least = near_dup.least_matches(0.8)
    assert len(least) == near_dup.SIZE // near_dup.BATCH and all(m < 0.8 * n for m, n in zip(least, range(32, 999, 32)))


@pytest.mark.parametrize("frame", ["odd", "real"])
def test_lattice(spark, odd, frame):
    import public_tokenizers

    docs = odd if frame == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    train = Counter()
    for d, t in rows:
        if not held(d):
            train.update([*lattice.words_of(t), None])
    n, v = sum(train.values()), len(train)
    got = lattice.lattice_scores(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    want = Counter()
    for d, t in rows:
        w = [*lattice.words_of(t), None]
        want[d, held(d), len(w), sum(train[x] > 0 for x in w), n, round(sum(np.log10((train[x] + 1) / (n + v + 1)) for x in w), 3)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lattice_sums_all_segmentations():
    pieces = [lattice.MARK, lattice.MARK + b"a", b"a", b"b", b"ab", b"ba"]
    first = np.array([p.startswith(lattice.MARK) for p in pieces])
    logp, end = lattice.normalized(np.arange(1.0, 13.0), first, 2.0)
    inside, ending = np.exp(logp).reshape(2, 6)
    assert inside[first].sum() + ending[first].sum() + np.exp(end) == pytest.approx(1) and inside[~first].sum() + ending[~first].sum() == pytest.approx(1)

    def total(rest, at):
        out = 0.0
        for i, p in enumerate(pieces):
            if rest.startswith(p) and first[i] == (at == 0):
                out += ending[i] if p == rest else inside[i] * total(rest[len(p) :], at + 1)
        return out

    model = lattice.Lattice(pieces, logp)
    for w in (b"a", b"ab", b"abba", b"bab", b"c"):
        want = total(lattice.MARK + w, 0)
        assert np.exp(model.score([w]))[0] == pytest.approx(want)
    uses = model.expected(__import__("pyarrow").array([b"abba"], __import__("pyarrow").binary()), np.array([2.0])).reshape(2, 6)
    assert uses[1].sum() == pytest.approx(2.0) and (uses.sum(0) * [0, 1, 1, 1, 2, 2]).sum() == pytest.approx(8.0)


def test_lattice_of_a_long_word():
    """Segments give what the whole matrix does, forward and in the expected uses; a word of a hundred thousand bytes is scored."""
    import pyarrow as pa
    import public_tokenizers

    pieces, logp = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    first = np.array([p.startswith(lattice.MARK) for p in pieces])
    model = lattice.Lattice(pieces, lattice.normalized(np.exp(np.tile(logp, 2)), first, 1.0)[0])
    r = random.Random(1)
    word = "".join(r.choice("etaoin shrdlu".replace(" ", "")) for _ in range(700)).encode()
    want, uses = model.score([word])[0], model.expected(pa.array([word], pa.binary()), np.array([2.0]))
    before = lattice.SEGMENT, lattice.LONG
    lattice.SEGMENT, lattice.LONG = 64, 100
    try:
        assert model.score([word])[0] == pytest.approx(want)
        assert np.allclose(model.expected(pa.array([word], pa.binary()), np.array([2.0])), uses)
    finally:
        lattice.SEGMENT, lattice.LONG = before
    assert model.score([word * 150])[0] < want


def test_lattice_training_raises_likelihood(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", F.lit(False).alias("held_out"))
    counts = lattice.word_counts(docs).cache()
    told = counts.toArrow()
    ll = []
    for rounds in (0, 1, 3):
        logp, _ = lattice.fit(counts, docs.count(), path, rounds)
        ll.append(float((lattice.Lattice(lattice.vocabulary(path)[0], logp).score(told["word"].to_pylist()) * told["train"].to_numpy()).sum()))
    assert ll[0] < ll[1] < ll[2]


def check_mix(rows, taken):
    sizes, got = Counter(), Counter()
    for d, s, n, t in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)))
    for s, t in taken:
        got[s] += t
    return goal, got


def test_mixing(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = mixing.mix_digest(docs).collect()
    again = mixing.mix_digest(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in rows.items()}
    assert all(r["size"] == size[r.doc_id] and r.taken in (0, size[r.doc_id], 2 * size[r.doc_id]) for r in got)
    goal, taken = check_mix([(d, r.source, size[d], 0) for d, r in rows.items()], [(rows[r.doc_id].source, r.taken) for r in got])
    for r in got:
        assert r.target == pytest.approx(goal[rows[r.doc_id].source]) and r.source_size == sum(size[d] for d in size if rows[d].source == rows[r.doc_id].source)
    assert abs(sum(taken.values()) - sum(goal.values())) < 0.02 * sum(goal.values())
    assert mixing.mix_digest(odd).count() == len(ODD) and mixing.mix_digest(empty).count() == 0
    out = mixing.mix(odd, F.array("source"), ("doc_id", "source", "text"))
    assert out.columns == odd.columns and max(Counter(r.doc_id for r in out.collect()).values()) <= 4


def test_each_source_comes_near_its_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_digest(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("longest")).collect()
    assert len(rows) > 2
    for r in rows:
        assert abs(r.taken - r.target) <= r.longest and abs(r.taken - r.target) < 0.02 * r.target + 50


def test_flow_costs_least():
    """Against all flows in whole words: the largest, and of those the cheapest."""
    r = random.Random(4)
    for _ in range(25):
        patterns = [(members, float(r.randrange(4))) for members in ((0,), (1,), (0, 1))]
        quotas = [float(r.randrange(6)), float(r.randrange(6))]
        options = []
        for a in range(int(2 * patterns[0][1]) + 1):
            for b in range(int(2 * patterns[1][1]) + 1):
                for c in range(int(2 * patterns[2][1]) + 1):
                    for d in range(int(2 * patterns[2][1]) - c + 1):
                        if a + c <= quotas[0] and b + d <= quotas[1]:
                            cost = sum(min(f, w) + 3 * max(0, f - w) for f, (_, w) in zip((a, b, c + d), patterns))
                            options.append((-(a + b + c + d), cost))
        flow = mixing.min_cost_flow(patterns, quotas, 2)
        total = [sum(f.values()) for f in flow]
        assert all(sum(f.get(s, 0) for f in flow) <= q + 1e-6 for s, q in enumerate(quotas))
        assert (-sum(total), sum(min(f, w) + 3 * max(0, f - w) for f, (_, w) in zip(total, patterns))) == pytest.approx(min(options))


def test_flow_of_overlapping_sources():
    # The shared pattern must serve the source that has nothing else, and nothing repeats while fresh words are left.
    flow = mixing.min_cost_flow([((0,), 100.0), ((0, 1), 100.0), ((1,), 0.0)], [100.0, 100.0], 2)
    assert flow[0] == {0: 100.0} and flow[1] == {1: 100.0}
    flow = mixing.min_cost_flow([((0,), 10.0)], [50.0], 2)
    assert flow == [{0: 20.0}]
    assert mixing.targets([100, 100, 0], [5, 2, 1], 1.5, 2) == pytest.approx([200, 100, 0])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, columns = docs.collect(), docs.columns
    langs = {r.doc_id for r in langid.keep_known_language(docs).collect()}
    assert langs >= {r.doc_id for r in rows if sum(c.isalpha() for c in r.text or "") > 200}
    first = P.language_id(spark, docs, SF)
    assert first.columns == columns
    kept = [(r.doc_id, r.text) for r in first.collect()]
    second = P.line_dedup(spark, first, SF)
    drop = brute_lines(kept)
    want = {}
    for d, t in kept:
        left = [x for i, x in enumerate(t.split("\n")) if drop.get(((True, d), i)) is None]
        if not words(t.replace("\n", " ")) or words(" ".join(left)):
            want[d] = "\n".join(left)
    assert {r.doc_id: r.text for r in second.collect()} == want
    third = P.near_dedup(spark, second, SF)
    groups = brute_near([(r.doc_id, r.text) for r in second.collect()], 5)
    assert {r.doc_id for r in third.collect()} == {d for d, c in groups.items() if d == c}
    fourth = P.source_mix(spark, third, SF)
    assert fourth.columns == columns and set(Counter(r.doc_id for r in fourth.collect()).values()) <= {1, 2}
    last = P.bpe_round_trip(spark, fourth, SF)
    texts = {r.doc_id: r.text for r in fourth.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last.collect())


def test_columns_that_clash_stay(spark):
    """Inner names of the operators in the input come out as they went in."""
    names = ["__row", "__rest", "__gone", "__all", "__pattern", "__size", "__at", "__copies", "gone", "a.b", "found", "row"]
    rows = [(i, f"{w} and some more words that say nothing", "en", "src0", *range(len(names))) for i, w in enumerate(["one", "two", "two"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    for out in (line_dedup.drop_duplicate_lines(df), near_dup.keep_one_of_each(df), mixing.mix(df, F.array("source"), ("doc_id",)), langid.keep_known_language(df)):
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(tuple(r)[4:] == tuple(range(len(names))) for r in got)


def test_rows_with_null_or_repeated_ids_are_told_apart(spark):
    """Neither unique lines nor whole documents go with a duplicate that shares their doc_id, and copies among them go."""
    rows = [(1, "a repeated line"), (None, "unique one\na repeated line"), (None, "unique two\nunique three"), (7, "alpha\na repeated line"), (7, "beta\ngamma"), (7, "beta\ndelta")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string")
    out = line_dedup.drop_duplicate_lines(df)
    # A null doc_id comes first, so the line at (null, 1) is the one that stays.
    assert out.columns == df.columns and sorted(r.text for r in out.collect()) == ["alpha", "beta\ngamma", "delta", "unique one\na repeated line", "unique two\nunique three"]
    assert line_dedup.line_decisions(df).count() == sum(t.count("\n") + 1 for _, t in rows)

    copies = [(None, "one two three four five six"), (None, "one two three four five six"), (8, "p q r s t u"), (8, "p q r s t u"), (8, "k l m n o p"), (9, "v w x y z"), (None, "v w x y z"), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in copies], "doc_id long, text string, kind string")
    kept = near_dup.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([copies[0], copies[2], copies[4], copies[5], copies[7]])
    told = near_dup.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in told) == Counter([(None, None, True), (None, None, False), (8, 8, True), (8, 8, False), (8, 8, True), (9, 9, True), (None, 9, False), (None, None, True)])


def test_language_rejects_gibberish_and_unlearned_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("char_length(text) > 200")
    r = random.Random(5)
    odd = [(10_000 + i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(r.choice((60, 300, 3000)))), None) for i in range(40)]
    odd += [(20_000, "Все люди рождаются свободными и равными в своем достоинстве и правах.", None), (20_001, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", None)]
    # French is there, but without a label nothing learns it.
    mixed = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang"))).unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    kept = {x.doc_id for x in langid.keep_known_language(mixed).collect()}
    rows = docs.collect()
    assert kept == {x.doc_id for x in rows if x.lang != "fr"} and any(x.lang == "fr" for x in rows)


def test_fragmented_files_are_not_passed_as_empty():
    file = media.write_track(bytes(384)) + media._box(b"moof", media._box(b"traf"))
    assert "fragments" in media.describe(file)["error"] and "error" not in media.describe(media.write_track(bytes(384)))
