"""Mixing overlapping sources to target weights by min-cost flow.

Documents are gathered by membership pattern (the set of sources they belong to). A flow takes
words from patterns to source quotas; the first copy of a pattern's words is cheaper than the
second, so costs are convex in repetition and nothing repeats while fresh words are left for the
same quota. The flow of a pattern then becomes whole documents in a seeded order.

Only aggregates by pattern reach the driver: ``MAX_PATTERNS`` rows, or an error.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import quoted
from tessera.session import materialize

MAX_PATTERNS = 5000
#: Buckets of the seeded order in which a pattern's cut is first sought.
BUCKETS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[float], weights: list[float], share: float, most: float) -> list[float]:
    """``share`` of all sizes dealt by weight; above ``most`` times its size a source stops and the excess is dealt again."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], float]], quotas: list[float], copies: int) -> list[dict[int, float]]:
    """Words that each pattern (its sources, its words) gives to each source.

    Successive shortest paths with potentials. Copy k of a pattern costs 2k - 1 a word; the flow
    is the largest that the quotas take, at the least cost. Costs are small integers, so paths
    of equal cost are augmented in the order of their nodes and reruns agree.
    """
    n, m = len(patterns), len(quotas)
    source, sink, tiny = n + m, n + m + 1, 1e-6
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def edge(a: int, b: int, capacity: float, price: float) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0.0, -price)):
            graph[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)

    for p, (members, words) in enumerate(patterns):
        for k in range(copies):
            edge(source, p, words, 2 * k + 1)
        for s in members:
            edge(p, n + s, copies * words, 0)
    for s, quota in enumerate(quotas):
        edge(n + s, sink, quota, 0)
    potential = [0.0] * (n + m + 2)
    while True:
        far, via = [float("inf")] * (n + m + 2), [-1] * (n + m + 2)
        far[source], heap = 0.0, [(0.0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                if room[e] > tiny and (new := d + cost[e] + potential[a] - potential[to[e]]) < far[to[e]] - 1e-9:
                    far[to[e]], via[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if via[sink] < 0:
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, far)]
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = to[via[at] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    out: list[dict[int, float]] = [{} for _ in patterns]
    for p in range(n):
        for e in graph[p]:
            if to[e] != source and not e & 1 and room[e ^ 1] > tiny:
                out[p][to[e] - n] = room[e ^ 1]
    return out


def words(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def sized(docs: DataFrame, members: Column, keys: tuple[str, ...], seed: int) -> DataFrame:
    """row (all columns of ``docs``), __pattern (its distinct sources in order, null as null), __size and __at (place in the seeded order)."""
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.array_sort(F.array_distinct(members)).alias("__pattern"), words("text").alias("__size"), seeded(seed, *keys).alias("__at"))


def plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """From :func:`sized` rows, the cut of each pattern and the size and target of each source.

    Cuts: __pattern, __copies (of every document), __upto (documents whose place is at most this
    get one more), __also (so does the document at this place, the one that best fills what is left).
    The order is searched by bucket first, so no pattern's documents are sorted in one task
    but those of one bucket. Rows that agree in all keys are taken or left together.
    """
    spark = rows.sparkSession
    found = rows.groupBy("__pattern").agg(F.sum("__size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({s for r in found for s in r["__pattern"]}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    found.sort(key=lambda r: [at[s] for s in r["__pattern"]])
    patterns = [(tuple(at[s] for s in r["__pattern"]), float(r["words"])) for r in found]
    sizes = [sum(w for members, w in patterns if i in members) for i in range(len(names))]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most)
    flows = [sum(f.values()) for f in min_cost_flow(patterns, goals, most)]
    cuts = []
    for r, (_, size), flow in zip(found, patterns, flows):
        whole = min(most, int(flow / size + 1e-9)) if size else 0
        cuts.append((r["__pattern"], whole, max(0.0, flow - whole * size) if whole < most else 0.0))
    cut = F.broadcast(spark.createDataFrame(cuts, "__pattern array<string>, copies int, rest double"))  # MAX_PATTERNS rows at most
    source = spark.createDataFrame([(s, int(n), t) for s, n, t in zip(names, sizes, goals)], "source string, source_size long, target double")

    bucket = F.shiftright(F.col("__at"), 64 - BUCKETS.bit_length() + 1)
    placed = rows.select("__pattern", "__size", "__at", bucket.alias("bucket")).join(cut, "__pattern").where("rest > 0")
    upto = Window.partitionBy("__pattern").orderBy("bucket")  # BUCKETS rows a pattern
    sums = placed.groupBy("__pattern", "rest", "bucket").agg(F.sum("__size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    edge = sums.where("upto > rest").groupBy("__pattern").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("room")), "bucket").alias("edge")).select("__pattern", "edge.*")
    inside = Window.partitionBy("__pattern").orderBy("__at")
    # The documents of the bucket in which the quota ends, and the last that still fits.
    last = (
        placed.join(F.broadcast(edge), ["__pattern", "bucket"])
        .withColumn("sum", F.sum("__size").over(inside))
        .groupBy("__pattern", "bucket", "room")
        .agg(F.max(F.when(F.col("sum") <= F.col("room"), F.struct("sum", "__at"))).alias("fits"), F.min("__at").alias("first"))
        .select("__pattern", F.coalesce("fits.__at", F.col("first") - 1).alias("upto"), (F.col("room") - F.coalesce("fits.sum", F.lit(0))).alias("gap"))
    )
    last = materialize(last, "mix-last")
    miss = F.abs(F.col("__size") - F.col("gap"))
    extra = placed.join(F.broadcast(last), "__pattern").where((F.col("__at") > F.col("upto")) & (miss < F.col("gap"))).groupBy("__pattern").agg(F.min(F.struct(miss, "__at")).alias("best")).select("__pattern", F.col("best.__at").alias("also"))
    out = cut.join(F.broadcast(last.select("__pattern", "upto")), "__pattern", "left").join(F.broadcast(extra), "__pattern", "left")
    # A pattern whose quota doesn't end before its last document gives all of them once more.
    upto_all = F.when((F.col("rest") > 0) & F.col("upto").isNull(), F.lit(2**63 - 1)).otherwise(F.col("upto"))
    return materialize(out.select("__pattern", F.col("copies").alias("__copies"), upto_all.alias("__upto"), F.col("also").alias("__also")), "mix-cuts"), source


def taken_copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """:func:`sized` rows with ``__copies``; a map-side join, as cuts have a row a pattern."""
    more = (F.col("__at") <= F.col("__upto")) | F.coalesce(F.col("__at") == F.col("__also"), F.lit(False))
    return rows.join(F.broadcast(cuts), "__pattern").withColumn("__copies", F.col("__copies") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0))


def mix_digest(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, each in the one source of its row.

    A null text has size 0; a null source is a source, the last; null doc_ids take part. An
    empty table gives no rows.
    """
    rows = materialize(sized(docs.select("doc_id", "source", "text"), F.array("source"), ("doc_id", "source", "text"), seed).select("row.doc_id", "row.source", "__pattern", "__size", "__at"), "mix-sized")
    cuts, source = plan(rows, weights, share, most)
    return (
        taken_copies(rows, cuts).join(F.broadcast(source.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s")))
        .select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"))
    )


def mix(docs: DataFrame, members: Column, keys: tuple[str, ...], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it (not at all to ``most`` times).

    ``members`` is an array of the sources a row belongs to; ``keys`` are the columns that tell
    rows apart.
    """
    rows = sized(docs, members, keys, seed)
    cuts, _ = plan(materialize(rows.select("__pattern", "__size", "__at"), "mix-sized"), weights, share, most)
    return taken_copies(rows, cuts).where("__copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")
