"""MinHash near-duplicate components with sequential Bayesian verification.

1. Each document becomes the set of its distinct word shingles, as 64-bit hashes, and a
   signature of ``BANDS * ROWS`` minima. Documents with equal sets are one class; the smallest
   row key stands for it, so copies never meet as pairs.
2. Classes that agree in all rows of a band share a bucket. In a bucket all members are compared
   with one pivot, the member that meets most others in all its buckets together, which is near
   the middle of its group. What links join is one component, so a large group of copies costs
   its size.
3. Where a bucket still holds several components, its members, but for the pivot, meet once more:
   not all with all, but those that share one of their rarest shingles, at places and with sizes
   that leave room for enough common ones. The prefix of each set that is searched is long enough
   that two sets which reach the threshold always meet. Members of a group below the threshold
   have little but shingles of their own in it, and meet few.
4. A pair compares its signatures in batches and is dropped once the posterior probability that
   its similarity reaches the threshold falls below ``MISS``; pairs whose sizes rule it out go
   first. Survivors are verified on their full sets.

Two documents of similarity 0.8 miss all buckets with probability (1 - 0.8^5)^32 = 3e-6. How
rare a shingle is comes from a count sketch of fixed size; a coarse count makes prefixes less
rare and the search slower, but loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROW, map_batches, restored, with_rows
from tessera.session import Tables, ship

BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
#: Signature places compared before the next look at the posterior.
BATCH = 32
MISS = 1e-7
#: Places of the sketch that tells how rare a shingle is.
PLACES = 1 << 17
#: Most row keys that are broadcast, some 16 MB; beyond, a join shuffles.
BROADCAST = 1 << 20
#: Most members that one copy of a pivot's set is compared with.
GROUP = 64
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_A = _mix(np.arange(1, SIZE + 1, dtype=np.uint64) * _K) | np.uint64(1)
_B = _mix(np.arange(1, SIZE + 1, dtype=np.uint64) * _K + np.uint64(7))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole text if it has fewer; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out + h[i : len(h) - k + 1 + i]) * _K
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out))


def signature(found: np.ndarray) -> np.ndarray:
    """The least of each of ``SIZE`` hashes over a set, upper 32 bits."""
    out = np.full(SIZE, ~np.uint64(0))
    for i in range(0, len(found), 2048):
        np.minimum(out, (found[i : i + 2048, None] * _A + _B).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def _signed(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, one, two, sigs = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, width)
            digest = hashlib.sha256(found.tobytes()).digest()
            n.append(len(found))
            one.append(int.from_bytes(digest[:8], "little", signed=True))
            two.append(int.from_bytes(digest[8:16], "little", signed=True))
            sigs.append(signature(found))
        all_ = np.stack(sigs)
        keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _K, (len(sigs), 1))
        for row in all_.reshape(len(sigs), BANDS, ROWS).transpose(2, 0, 1).astype(np.uint64):
            keys = _mix(keys + row)
        bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
        columns = [batch.column(ROW), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([s.astype("<u2").tobytes() for s in sigs], pa.binary()), bands]
        return pa.RecordBatch.from_arrays(columns, [ROW, "doc_id", "n_shingles", "d1", "d2", "sig", "bands"])

    return run


def least_matches(share: float, miss: float = MISS) -> list[int]:
    """By number of batches compared: matches below which a pair is dropped.

    With a uniform prior the posterior of the similarity after m matches of n is a beta
    distribution, and the probability that it reaches ``share`` is that of at most m successes
    of n + 1 with chance ``share``.
    """
    out = []
    for n in range(BATCH, SIZE + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
            if total >= miss:
                out.append(m)
                break
    return out


def _likely(least: list[int]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SIZE) for c in ("sig_a", "sig_b"))
        alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
        for k, need in enumerate(least):
            at = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (a[alive, at] == b[alive, at]).sum(axis=1)
            alive, matches = alive[matches >= need], matches[matches >= need]
        return batch.select(["a", "b"]).take(pa.array(alive)) if len(alive) else None

    return run


def _verified(percent: int):
    """Rows sorted by (a, part, kind): a pivot's set, then those of its partners; memory holds one pivot's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = np.zeros(0, np.uint64), None
        for batch in batches:
            left, right = [], []
            for a, part, b, found in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "found"))):
                other = np.frombuffer(found, np.uint64)
                if b is None:
                    own, of = other, (a, part)
                    continue
                if of != (a, part):
                    raise RuntimeError("a pivot's set is missing")
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    left.append(a), right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _links(t: Tables, turn: str, pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Each a is met by several b."""
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    sig = sigs.select("doc", "n_shingles", "sig")
    both = pairs.join(sig.toDF("b", "n_b", "sig_b"), "b").join(sig.toDF("a", "n_a", "sig_a"), "a").where(fits).select("a", "b", "sig_a", "sig_b")
    likely = t.write(f"likely-{turn}", map_batches(both, _likely(least_matches(percent / 100)), "a long, b long"))
    parts = likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    pivots = parts.join(sets, F.col("a") == F.col("doc")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "found")
    others = likely.join(parts, "a").join(sets, F.col("b") == F.col("doc")).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "found")
    rows = pivots.unionByName(others)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    links = t.write(f"links-{turn}", rows.mapInArrow(_verified(percent), "a long, b long"))
    t.drop(f"likely-{turn}")
    return links


def components(t: Tables, edges: DataFrame) -> DataFrame:
    """doc, component (the smallest reachable doc) of each end of ``edges`` (a, b).

    Alternating large and small stars: each node hands its larger, then its smaller neighbours
    the smallest node it knows. Edges stay in tables; only two sums reach the driver a round.
    """
    now, state = t.measured("stars-0", edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "u", "v")
    before, turn = None, 0
    while state != before and state[0]:
        before, turn = state, turn + 1
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, state = t.measured(f"stars-{turn}", small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "u", "v")
        t.drop(f"stars-{turn - 1}")
    ends = now.select(F.col("u").alias("doc"), F.col("v").alias("component"))
    found = t.write("components", ends.unionByName(now.select(F.col("v").alias("doc"), F.col("v").alias("component"))).distinct())
    t.drop(f"stars-{turn}")
    return found


def required(percent: int, n: str, m: str) -> str:
    """SQL: how many elements sets of n and m elements share at least, if they reach the threshold."""
    return f"ceil({percent} * ({n} + {m}) / {100 + percent}.0D - 1e-9)"


def _places(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """token, at, doc, n, component: the rarest shingles of each set, as many as its threshold asks for.

    A token in a place of the sketch that was met once has no partner and is left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for found in batch.column("found").to_pylist():
                total += np.bincount(_places(np.frombuffer(found, np.uint64)), minlength=PLACES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])

    sketch = np.zeros(PLACES, np.int64)
    told = sets.select("found").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # PLACES rows at most
    sketch[told["place"].to_numpy()] = told["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(sketch)

    def rarest(batch: pa.RecordBatch) -> pa.RecordBatch:
        token, at, size = [], [], []
        for found in batch.column("found").to_pylist():
            own = np.frombuffer(found, np.uint64)
            often = shared.value[_places(own)]
            order = np.lexsort((own, often))[: len(own) - -(-percent * len(own) // 100) + 1]
            place = np.flatnonzero(often[order] > 1)
            token.append(own[order[place]].view(np.int64)), at.append(place), size.append(len(place))
        rows = pa.array(np.repeat(np.arange(len(size)), size))
        columns = [pa.array(np.concatenate(token)), pa.array(np.concatenate(at)), *(batch.column(c).take(rows) for c in ("doc", "n_shingles", "component"))]
        return pa.RecordBatch.from_arrays(columns, ["token", "at", "doc", "n", "component"])

    return map_batches(sets, rarest, "token long, at long, doc long, n long, component long")


def _met(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a token with room for enough common elements behind it.

    At each token the documents of its most frequent component meet the others alone, so that a
    large group that is one component already costs its size.
    """
    kinds = prefixes.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = kinds.groupBy("token").agg(F.max(F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", F.col("most.component").alias("most"))
    x, y = (prefixes.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("at", "doc", "n", "component"))) for s in "xy")
    room = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y) AND least(n_x - at_x, n_y - at_y) >= {required(percent, 'n_x', 'n_y')}"
    met = x.join(mixed, "token").where("component_x != most").join(y, "token").where(f"component_x != component_y AND {room}")
    return met.select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Linked are documents whose sets' intersection is at least ``percent`` of their union;
    component_id is the smallest doc_id reachable, null if all are null. Each row is a document
    of its own, whatever its doc_id: of a component the first row by doc_id, nulls last, is kept.
    Documents without words (null, empty, blank) are linked with nothing. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    t = Tables(docs.sparkSession, "near")
    out = _near(t, t.write("docs", docs.withColumn(ROW, F.monotonically_increasing_id())), width, percent).drop(ROW)
    t.drop("docs")
    return out


def _near(t: Tables, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """:func:`near_duplicates` of keyed documents, with their row key. ``docs`` isn't read by the result."""
    ship(docs.sparkSession)
    docs = docs.select(ROW, F.col("doc_id").cast("long"), "text")
    signed = t.write("signed", map_batches(docs, _signed(width), f"{ROW} long, doc_id long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>"))
    linkable = signed.where("n_shingles > 0")
    classes = t.write("classes", linkable.groupBy("d1", "d2").agg(F.min(ROW).alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("head")))

    first = t.write("buckets", linkable.join(classes, F.col(ROW) == F.col("rep"), "left_semi").select(F.col(ROW).alias("doc"), F.explode("bands").alias("bucket")))
    shared, (n_shared, _) = t.measured("shared", first.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi").select("bucket", "size"), "bucket")
    by_bucket = lambda df: F.broadcast(df) if n_shared <= BROADCAST else df
    members = t.write("members", first.join(by_bucket(shared), "bucket").select("bucket", "doc", "size").distinct())
    t.drop("buckets", "shared")

    middle = members.groupBy("doc").agg(F.sum("size").alias("meets"))
    ids, (n_ids, _) = t.measured("ids", middle, "doc")
    only = lambda df, key: df.join(F.broadcast(ids) if n_ids <= BROADCAST else ids, F.col(key) == F.col("doc"), "left_semi")
    pivots = t.write("pivots", members.join(ids, "doc").groupBy("bucket").agg(F.max(F.struct("meets", "doc")).alias("p")).select("bucket", F.col("p.doc").alias("pivot")))
    placed = members.join(by_bucket(pivots), "bucket").where("doc != pivot").select("bucket", "pivot", "doc")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(ROW), pa.array([shingles(x, width).tobytes() for x in batch.column("text").to_pylist()], pa.binary())], ["doc", "found"])

    sigs = t.write("sigs", only(signed.select(ROW, "n_shingles", "sig"), ROW).withColumnRenamed(ROW, "doc"))
    told = t.write("told", signed.select(ROW, "doc_id", "n_shingles", "d1", "d2"))
    t.drop("signed")
    found = t.write("sets", map_batches(only(docs, ROW), sets, "doc long, found binary"))

    pairs = t.write("pairs", placed.select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct())
    near = components(t, _links(t, "pivots", pairs, sigs, found, percent)).withColumnRenamed("component", "near")
    known = t.write("known", ids.select("doc").join(near, "doc", "left").select("doc", F.coalesce("near", "doc").alias("component")))
    t.drop("pairs", "links-pivots", "components")

    placed = placed.select("bucket", "doc").join(known, "doc")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
    open_, (n_open, _) = t.measured("open", placed.join(mixed, "bucket").select("doc", "component").distinct(), "doc")
    if n_open:
        some = F.broadcast(open_) if n_open <= BROADCAST else open_
        some = t.write("open-sets", found.join(some, "doc").join(sigs.select("doc", "n_shingles"), "doc"))
        prefixes = t.write("prefixes", _prefixes(some, percent))
        pairs = t.write("met", _met(prefixes, percent))
        t.drop("open-sets", "prefixes")
        links = _links(t, "met", pairs, sigs, found, percent)
        # The links of this turn join components of the last.
        of = known.toDF("doc", "of")
        joined = links.join(of.withColumnRenamed("doc", "a"), "a").withColumnRenamed("of", "x").join(of.withColumnRenamed("doc", "b"), "b").select(F.col("x").alias("a"), F.col("of").alias("b"))
        new = components(t, joined).toDF("component", "new")
        known = t.write("joined", known.join(new, "component", "left").select("doc", F.coalesce("new", "component").alias("component")))
        t.drop("met", "links-met", "components")
    t.drop("members", "pivots", "sigs", "sets", "open", "ids")

    # The first row of each component that joins classes; any other class has its own.
    joined = classes.join(known.withColumnRenamed("doc", "rep"), "rep")
    heads = joined.groupBy("component").agg(F.min("head").alias("least"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("component", "least")
    least = joined.join(heads, "component").select("rep", "least")
    first = t.write("heads", classes.join(least, "rep", "left").select("d1", "d2", F.coalesce("least", "head").alias("head")))
    t.drop("classes", "known", "joined")
    mine = told.join(first, ["d1", "d2"], "left")
    linked = F.col("n_shingles") > 0
    return mine.select(ROW, "doc_id", "n_shingles", F.when(linked, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), (~linked | (F.col(f"head.{ROW}") == F.col(ROW))).alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each component of ``docs``; all columns stay."""
    columns = docs.columns
    docs, t = with_rows(docs, "near-docs"), Tables(docs.sparkSession, "near")
    gone, (n, _) = t.measured("gone", _near(t, docs, width, percent).where("NOT kept").select(ROW), ROW)
    t.drop("told", "heads")
    return docs.join(F.broadcast(gone) if n <= BROADCAST else gone, ROW, "left_anti").select(*map(restored, columns))
