"""The link graph: typed edges between entity references, kept canonical, repointed on merges, closed over identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import reconcile
from tessera.session import materialize

URN = r"^([a-z][a-z_-]*):([0-9a-fA-F-]{36}|[0-9]+)$"


def urn(ref: Column | str) -> Column:
    """Struct of type and id of ``type:id``, null if malformed."""
    r = F.col(ref) if isinstance(ref, str) else ref
    return F.when(r.rlike(URN), F.struct(F.regexp_extract(r, URN, 1).alias("type"), F.lower(F.regexp_extract(r, URN, 2)).alias("id")))


def canonical(edges: DataFrame, symmetric: list[str]) -> DataFrame:
    """Ends of symmetric kinds in order, so that an edge has one form."""
    both = F.col("kind").isin(symmetric)
    return edges.withColumns({"from_ref": F.when(both, F.least("from_ref", "to_ref")).otherwise(F.col("from_ref")), "to_ref": F.when(both, F.greatest("from_ref", "to_ref")).otherwise(F.col("to_ref"))})


def repoint(edges: DataFrame, merges: DataFrame, symmetric: list[str]) -> DataFrame:
    """Edges after merges (old, new): ends replaced, self-loops and duplicates dropped (the smallest edge_id stays)."""
    for end in ("from_ref", "to_ref"):
        m = merges.select(F.col("old").alias("__o"), F.col("new").alias("__n"))
        edges = edges.join(m, F.col(end) == F.col("__o"), "left").withColumn(end, F.coalesce("__n", end)).drop("__o", "__n")
    edges = canonical(edges.where("from_ref != to_ref"), symmetric)
    rest = [c for c in edges.columns if c not in ("from_ref", "to_ref", "kind")]
    one = edges.groupBy("from_ref", "to_ref", "kind").agg(F.min_by(F.struct(*rest), "edge_id").alias("r"))
    return one.select("from_ref", "to_ref", "kind", *[F.col("r")[c].alias(c) for c in rest])


def status(edges: DataFrame, presence: DataFrame) -> DataFrame:
    """dangling if an end is dead, verified if both are known alive, else unverified. presence: ref, alive."""
    for end in ("from", "to"):
        p = presence.select(F.col("ref").alias(f"__{end}"), F.col("alive").alias(f"__{end}_alive"))
        edges = edges.join(p, F.col(f"{end}_ref") == F.col(f"__{end}"), "left")
    dead = ~F.coalesce("__from_alive", F.lit(True)) | ~F.coalesce("__to_alive", F.lit(True))
    alive = F.col("__from_alive") & F.col("__to_alive")
    told = F.when(dead, "dangling").when(F.coalesce(alive, F.lit(False)), "verified").otherwise("unverified")
    return edges.withColumn("status", told).drop("__from", "__from_alive", "__to", "__to_alive")


def permitted(edges: DataFrame, kinds: list[tuple[str, str, str]]) -> DataFrame:
    """Edges whose kind allows the types of their ends."""
    allowed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in kinds])
    return edges.where(F.array_contains(allowed, F.struct(F.col("kind").alias("k"), F.substring_index("from_ref", ":", 1).alias("a"), F.substring_index("to_ref", ":", 1).alias("b"))))


def identity_closure(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """ref, identity (the smallest reachable ref), by pointer jumping over tables until nothing changes."""
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x != y").distinct(), "graph-edges")
    label = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), "graph-labels")
    while True:
        near = both.join(label.select(F.col("x").alias("y"), F.col("m").alias("n")), "y").groupBy("x").agg(F.min("n").alias("n"))
        step = label.join(near, "x").select("x", F.least("m", "n").alias("m"))
        jump = step.join(step.select(F.col("x").alias("m"), F.col("m").alias("m2")), "m", "left").select("x", F.least("m", F.coalesce("m2", "m")).alias("m"))
        new = materialize(jump, "graph-labels")
        if new.join(label.withColumnRenamed("m", "old"), "x").where("m != old").isEmpty():
            return new.select(F.col("x").alias("ref"), F.col("m").alias("identity"))
        label = new


def neighbours(edges: DataFrame, start: DataFrame, depth: int, kinds: list[str] | None = None, direction: str = "both") -> DataFrame:
    """ref, depth: first depth at which each ref is reached from ``start`` (ref)."""
    if kinds:
        edges = edges.where(F.col("kind").isin(kinds))
    steps = edges.select(F.col("from_ref").alias("x"), F.col("to_ref").alias("y")) if direction != "in" else edges.select(F.col("to_ref").alias("x"), F.col("from_ref").alias("y"))
    if direction == "both":
        steps = steps.unionByName(steps.select(F.col("y").alias("x"), F.col("x").alias("y")))
    seen = start.select("ref").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1).join(steps, F.col("ref") == F.col("x")).select(F.col("y").alias("ref")).distinct()
        seen = materialize(seen.unionByName(front.join(seen, "ref", "left_anti").withColumn("depth", F.lit(d))), "graph-seen")
    return seen


def stitch(legs: DataFrame, journey: str) -> DataFrame:
    """Totals of a journey's legs (resolved, t0, t1, lead_ms); withheld unless every leg is resolved."""
    n = legs.groupBy(journey).agg(F.count(F.lit(1)).alias("legs"), F.bool_and("resolved").alias("complete"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("lead_ms").alias("lead_ms"))
    return n.withColumns({c: F.when(F.col("complete"), F.col(c)) for c in ("t0", "t1", "lead_ms")})


def merge_fold(records: DataFrame, merges: DataFrame, key: str, name: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """Main records after merges (main, duplicate): scalars keep the main's value or take the first duplicate's,
    lists unite in order, a duplicate's other name becomes an alternate. Chains end at their last main."""
    root = identity_closure(merges, "main", "duplicate")
    mains = merges.select(F.col("main").alias("ref")).join(merges.select(F.col("duplicate").alias("ref")), "ref", "left_anti").distinct()
    top = root.join(mains, "ref").select("identity", F.col("ref").alias("top"))
    rows = records.join(root.join(top, "identity").select(F.col("ref").alias(key), "top"), key, "left").withColumn("top", F.coalesce("top", key))
    order = F.struct((F.col(key) != F.col("top")).alias("o"), F.col(key).alias("k"), *[F.col(c) for c in (name, *lists, *scalars)])
    all_ = rows.groupBy(F.col("top").alias(key)).agg(F.array_sort(F.collect_list(order)).alias("all"))
    first = lambda c: F.get(F.filter(F.transform("all", lambda r: r[c]), lambda x: x.isNotNull()), F.lit(0))
    united = lambda c: F.array_distinct(F.flatten(F.transform("all", lambda r: F.coalesce(r[c], F.array()))))
    names = F.array_distinct(F.transform("all", lambda r: r[name]))
    return all_.select(key, first(name).alias(name), F.filter(names, lambda x: x.isNotNull() & (x != F.get(F.col("all"), F.lit(0))[name])).alias("alternate_names"), *[united(c).alias(c) for c in lists], *[first(c).alias(c) for c in scalars])


def with_kinds(edges: DataFrame, kinds: list[tuple[str, str, bool, bool]]) -> DataFrame:
    """``edges`` with the inverse of their kind and whether it is temporal and sensitive; nulls for an unknown kind."""
    known = edges.sparkSession.createDataFrame(kinds, "kind string, inverse string, temporal boolean, sensitive boolean")
    return edges.join(F.broadcast(known), "kind", "left")  # a row a kind


def chain_walk(links: DataFrame, starts: DataFrame, most: int = 16) -> DataFrame:
    """start, leg, position of the legs (leg, next) reached from each start, ``most`` at most; a leg is visited once, so cycles end."""
    at = starts.select(F.col("leg").alias("start"), "leg", F.array("leg").alias("seen")).join(links, "leg")
    out = at.select("start", "leg", F.lit(1).alias("position"))
    for position in range(2, most + 1):
        step = at.select("start", "seen", F.col("next").alias("leg")).join(links, "leg").where(~F.array_contains("seen", F.col("leg")))
        at = materialize(step.select("start", "leg", F.array_append("seen", F.col("leg")).alias("seen"), "next"), "graph-chain")
        if at.isEmpty():
            break
        out = out.unionByName(at.select("start", "leg", F.lit(position).alias("position")))
    return out


def reconcile_edges(have: DataFrame, want: DataFrame, kinds: list[tuple[str, str, str]]) -> DataFrame:
    """from_ref, to_ref, kind, side: rejected (wanted, but of types its kind forbids), missing, or extra."""
    key = ["from_ref", "to_ref", "kind"]
    good = permitted(want.select(*key).distinct(), kinds)
    rejected = want.select(*key).distinct().join(good, key, "left_anti").withColumn("side", F.lit("rejected"))
    return rejected.unionByName(reconcile(good, have, key))
