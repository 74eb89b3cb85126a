"""Exact top-k inner products by best-first search of M-trees.

Vectors of integers lie in a metric space with one more coordinate, sqrt(M^2 - |x|^2), where M
is the largest norm; a query's is 0. There the inner product falls as the distance grows:
d^2 = |q|^2 + M^2 - 2 <q, x>. So the search for the largest inner products is one for the
nearest neighbours, in which the triangle inequality holds.

Index: each vector goes to the nearest of ``REGIONS`` routing vectors, which come from a bounded
sample. A region is dealt by hash to trees of at most ``capacity`` vectors, so a third of all
rows in one region makes many trees and not one large task. A tree has two levels of paged
nodes, each with its routing object, covering radius and distance to its parent; leaf entries
have their distance to the leaf's routing object. All rows are indexed.

Search: a query first searches the tree that holds it, which bounds its k-th best score. Then it
goes to the other trees whose covering radius doesn't rule them out. In a tree nodes come in the
order of their best possible score. A distance is computed only where the stored distances
don't already exclude the node or entry: |d(q, parent) - d(object, parent)| is a lower bound.
Bounds get a slack for rounding; scores are exact integers, and beyond 64 bits the nearest 64-bit
integer, where they tie.

Components are kept as doubles, which hold each integer floor(64 x) exactly. Products that a double
or a 64-bit integer may not hold are made of Python's integers. Where norms are too large for
doubles, nothing is excluded by distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import map_batches
from tessera.session import materialize, ship

REGIONS = 64
#: Vectors in a leaf and under an inner node.
LEAF, INNER = 256, 2048
#: Vectors in a tree, at least; and trees and bytes of the broadcast directory, about.
CAPACITY, TREES, DIRECTORY = 8192, 16384, 64 << 20
#: Dimensions, the most frequent ones, that have routing vectors; trees of others are dealt by hash alone.
ROUTED = 64
#: Queries that search a tree in one task.
QUERIES = 4096
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_SLACK = 1e-7


def quantize(df: DataFrame, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """row, vec_id, dim, v (floor(scale * x) of each component as little-endian doubles), norm2.

    Rows with a null vec_id, a null or empty vector, or a component that is null or not finite,
    before or after scaling, are left out. Rows with equal vec_id stay rows of their own.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scale * x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & finite)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors, norms = [], []
        e = batch.column("e")
        ends, values = np.asarray(e.offsets), np.asarray(e.values)
        for a, b in zip(ends[:-1], ends[1:]):
            x = np.floor(scale * values[a:b]) + 0.0
            vectors.append(x.astype("<f8").tobytes())
            with np.errstate(over="ignore"):
                norms.append(float((x * x).sum()))
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(np.diff(ends).astype(np.int32)), pa.array(vectors, pa.binary()), pa.array(norms)], ["row", "vec_id", "dim", "v", "norm2"])

    return map_batches(rows, run, "row long, vec_id long, dim int, v binary, norm2 double")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _scores(vectors: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of integer vectors with one, within 64 bits; ``largest``: no component of ``vectors`` is larger."""
    most = largest * np.abs(q).max() * len(q)
    if most < 2**52:
        return (vectors @ q).astype(np.int64)
    if most < 2**62 and max(largest, np.abs(q).max()) < 2**62:
        return vectors.astype(np.int64) @ q.astype(np.int64)
    own = [*map(int, q.tolist())]
    return np.array([min(MOST, max(LEAST, sum(x * int(y) for x, y in zip(own, v)))) for v in vectors.tolist()], np.int64)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    """The last coordinate."""
    return np.sqrt(np.maximum(top - (x * x).sum(axis=-1), 0.0))


def _points(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors in the metric space; the origin where it has no finite distances, so that nothing is excluded there."""
    if not np.isfinite(8 * top):
        return np.zeros((len(x), x.shape[1] + 1))
    return np.concatenate([x, _lift(x, top)[:, None]], axis=1)


def _halves(points: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row sets of at most ``most``, cut across the line between two far points."""
    if len(rows) <= most:
        yield rows
        return
    own = points[rows]
    a = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    b = own[((own - a) ** 2).sum(axis=1).argmax()]
    order = np.argsort(own @ (b - a), kind="stable")
    # A multiple of ``most`` on the left, so that pages are full.
    half = max(most, len(rows) // 2 // most * most)
    yield from _halves(points, rows[order[:half]], most)
    yield from _halves(points, rows[order[half:]], most)


def _page(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The routing object, the member nearest to the mean, and each member's distance to it."""
    own = points[rows]
    center = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()]
    return center, np.sqrt(((own - center) ** 2).sum(axis=1))


NODE = "dim int, tree string, node int, parent int, center binary, radius double, up double, rows binary, ids binary, vectors binary, out binary"


def _build(top: float):
    """The pages of one tree: node 0 is the root, then inner nodes and leaves; only leaves have entries."""

    def run(table: pa.Table) -> pa.Table:
        dim, tree = table["dim"][0].as_py(), table["tree"][0].as_py()
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        v = _matrix(table["v"], dim)
        points = _points(v, top)
        ids, rows = table["vec_id"].to_numpy(), table["row"].to_numpy()
        nodes: list[dict] = []

        def add(parent: int, members: np.ndarray, leaf: bool) -> int:
            center, out = _page(points, members)
            up = float(np.sqrt(((center - np.frombuffer(nodes[parent]["center"])) ** 2).sum())) if nodes else 0.0
            entry = {"dim": dim, "tree": tree, "node": len(nodes), "parent": parent, "center": center.tobytes(), "radius": float(out.max()), "up": up, "rows": None, "ids": None, "vectors": None, "out": None}
            if leaf:
                entry |= {"rows": rows[members].astype("<i8").tobytes(), "ids": ids[members].astype("<i8").tobytes(), "vectors": v[members].astype("<f8").tobytes(), "out": out.tobytes()}
            nodes.append(entry)
            return entry["node"]

        root = add(0, np.arange(len(v)), False)
        for inner in _halves(points, np.arange(len(v)), INNER):
            at = add(root, inner, False)
            for leaf in _halves(points, inner, LEAF):
                add(at, leaf, True)
        return pa.Table.from_pylist(nodes, pa.schema([("dim", pa.int32()), ("tree", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("center", pa.binary()), ("radius", pa.float64()), ("up", pa.float64()), *((c, pa.binary()) for c in ("rows", "ids", "vectors", "out"))]))

    return run


def _search(k: int, top: float):
    """One tree and a block of queries: each query's best entries, at most k, that may still be among its k best."""

    def run(key: tuple, pages: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query": [], "query_id": [], "vec_id": [], "score": [], "row": []}
        if pages.num_rows and queries.num_rows:
            dim, nodes = key[0].as_py(), pages.sort_by("node").to_pylist()
            centers = np.stack([np.frombuffer(n["center"]) for n in nodes])
            radius, up = np.array([n["radius"] for n in nodes]), np.array([n["up"] for n in nodes])
            below: list[list[int]] = [[] for _ in nodes]
            for n in nodes[1:]:
                below[n["parent"]].append(n["node"])
            kids = [np.array(b, int) for b in below]
            leaf = {n["node"]: (np.frombuffer(n["rows"], "<i8"), np.frombuffer(n["ids"], "<i8"), np.frombuffer(n["vectors"], "<f8").reshape(-1, dim), np.frombuffer(n["out"])) for n in nodes if n["rows"] is not None}
            q = _matrix(queries["v"], dim)
            bound = queries["bound"].to_pylist()
            for i, (own, own_id) in enumerate(zip(queries["row"].to_pylist(), queries["vec_id"].to_pylist())):
                for s, j, r in _best_first(q[i], own, bound[i], centers, radius, up, kids, leaf, k, top):
                    found["query"].append(own), found["query_id"].append(own_id), found["vec_id"].append(j), found["score"].append(s), found["row"].append(r)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in found.items()})

    return run


def _far(score: int | None, reach: float) -> float:
    """Beyond this distance scores are below ``score``; ``reach`` is the sum of the squares of the query and the largest vector."""
    if score is None or score <= LEAST or not np.isfinite(8 * reach):
        return np.inf
    slack = _SLACK * (reach + 1)
    return np.sqrt(max(reach - 2.0 * score + slack, 0.0)) + np.sqrt(slack) * 1e-3


def _best_first(q, own, bound, centers, radius, up, kids, leaf, k, top, computed: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(score, vec_id, row) of the best entries of a tree. ``bound``: a score that k entries elsewhere reach, or None.

    ``computed`` gets the number of distances and products computed in each node.
    """
    largest = np.sqrt(top)  # no vector has a larger component
    with np.errstate(over="ignore"):
        reach = float(q @ q) + top
    at = np.append(q, 0.0) if np.isfinite(8 * reach) else np.zeros(len(q) + 1)

    def far(score: int | None) -> float:
        return _far(score, reach)

    def note(n: int) -> None:
        if computed is not None:
            computed.append(n)

    best: list[tuple[int, int, int]] = []  # a heap with the worst first: score, -vec_id, row
    limit = far(bound)
    d0 = float(np.sqrt(((centers[0] - at) ** 2).sum()))
    heap = [(max(0.0, d0 - radius[0]), 0, d0)]
    while heap:
        least, node, d = heapq.heappop(heap)
        if least > limit:
            break
        if node in leaf:
            rows, ids, vectors, out = leaf[node]
            some = np.flatnonzero((np.abs(d - out) <= limit) & (rows != own))
            if not len(some):
                continue
            note(len(some))
            scores = _scores(vectors[some], q, largest)
            floor = best[0][0] if len(best) == k else bound
            if floor is not None:
                good = np.flatnonzero(scores >= floor)
                scores, some = scores[good], some[good]
            if len(scores) > k:  # ties with the k-th stay in
                good = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                scores, some = scores[good], some[good]
            for s, j, r in zip(map(int, scores.tolist()), ids[some].tolist(), rows[some].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (s, -j, r))
                elif (s, -j) > best[0][:2]:
                    heapq.heapreplace(best, (s, -j, r))
            if len(best) == k:
                limit = min(limit, far(best[0][0]))
            continue
        some = kids[node]
        some = some[np.abs(d - up[some]) - radius[some] <= limit]  # these need a distance
        if len(some):
            note(len(some))
            ds = np.sqrt(((centers[some] - at) ** 2).sum(axis=1))
            for x, dx in zip(some.tolist(), ds.tolist()):
                if dx - radius[x] <= limit:
                    heapq.heappush(heap, (max(0.0, dx - radius[x]), x, dx))
    return [(s, -j, r) for s, j, r in best]


def build(vectors: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, float]:
    """The pages of all trees, the tree of each row, and the square of the largest norm."""
    spark = vectors.sparkSession
    sums = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("top"))
    whole = sums.agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.max("dim").alias("dim")).head()
    top, total = whole["top"] or 0.0, whole["n"] or 0
    trees = max(REGIONS, min(TREES, DIRECTORY // (8 * ((whole["dim"] or 0) + 1))))
    capacity = max(capacity, -(-2 * total // trees))
    # Only dimensions that don't fit one tree are routed; a dimension without routing vectors has one region.
    large = sums.where(F.col("n") > capacity).orderBy(F.desc("n"), "dim").limit(ROUTED).collect()
    routing = {}
    for r in large:
        some = vectors.where(F.col("dim") == r["dim"]).select("v").orderBy(F.xxhash64("v"), "v").limit(REGIONS).collect()
        routing[r["dim"]] = np.frombuffer(b"".join(x["v"] for x in some), "<f8").reshape(-1, r["dim"])

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for dim, v in zip(batch.column("dim").to_pylist(), batch.column("v").to_pylist()):
            if (c := routing.get(dim)) is None or not np.isfinite(8 * top):
                out.append(0)
                continue
            x = np.frombuffer(v, "<f8")
            out.append(int((c @ x + _lift(c, top) * _lift(x, top)).argmax()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "region"])

    placed = materialize(map_batches(vectors, assign, "row long, vec_id long, dim int, v binary, norm2 double, region int"), "mtree-regions")
    sizes = placed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / capacity).cast("int").alias("parts"))
    tree = F.concat_ws("/", "region", F.pmod(F.xxhash64("row"), F.col("parts")))
    placed = placed.join(sizes, ["dim", "region"]).withColumn("tree", tree).drop("region", "parts")
    ship(spark)
    pages = materialize(placed.select("dim", "tree", "row", "vec_id", "v").groupBy("dim", "tree").applyInArrow(_build(top), NODE), "mtree-pages")
    return pages, placed, top


FOUND = "query long, query_id long, vec_id long, score long, row long"


def _visit(pages: DataFrame, visits: DataFrame, k: int, top: float) -> DataFrame:
    """Searches (dim, tree, row, vec_id, v, bound); a tree's queries go in blocks of some ``QUERIES``."""
    blocks = visits.groupBy("dim", "tree").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    queries = visits.join(blocks, ["dim", "tree"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    copies = pages.join(blocks, ["dim", "tree"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ["dim", "tree", "block"]
    return copies.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(_search(k, top), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row among all other rows.

    ``vectors`` as from :func:`quantize`; only vectors of a query's dimension are its
    candidates. Ties go to the smaller vec_id, then in the order of rows. Fewer than k
    candidates are all returned; a query without candidates has no row.
    """
    vectors = materialize(vectors, "mtree-vectors")
    pages, placed, top = build(vectors)
    queries = materialize(placed.where(is_query).select("dim", "tree", "row", "vec_id", "v"), "mtree-queries")
    home = materialize(_ranked(_visit(pages, queries.withColumn("bound", F.lit(None).cast("long")), k, top), k), "mtree-home")
    bounds = home.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("bound"))
    waiting = queries.withColumnRenamed("tree", "home").join(bounds, "row", "left")
    # A query of a dimension with one tree has been there. Other dimensions have some ``trees`` trees
    # in all, as each holds more than ``capacity`` vectors.
    several = pages.where("node = 0").groupBy("dim").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("dim")
    directory = pages.where("node = 0").select("dim", "tree", "center", "radius").join(several, "dim", "left_semi").toArrow()
    of = {}
    for dim in set(directory["dim"].to_pylist()):
        some = directory.filter(pyarrow.compute.equal(directory["dim"], dim))
        of[dim] = (some["tree"].to_pylist(), np.frombuffer(b"".join(some["center"].to_pylist())).reshape(-1, dim + 1), some["radius"].to_numpy())
    shared = vectors.sparkSession.sparkContext.broadcast(of)

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        trees = []
        for dim, home_tree, v, bound in zip(*(batch.column(c).to_pylist() for c in ("dim", "home", "v", "bound"))):
            if dim not in shared.value:
                trees.append([])
                continue
            names, centers, radius = shared.value[dim]
            q = np.frombuffer(v, "<f8")
            with np.errstate(over="ignore"):
                reach = float(q @ q) + top
            at = np.append(q, 0.0) if np.isfinite(8 * reach) else np.zeros(dim + 1)
            near = np.sqrt(((centers - at) ** 2).sum(axis=1)) - radius <= _far(bound, reach)
            trees.append([names[i] for i in np.flatnonzero(near).tolist() if names[i] != home_tree])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("dim", "row", "vec_id", "v", "bound")), pa.array(trees, pa.list_(pa.string()))], ["dim", "row", "vec_id", "v", "bound", "trees"])

    routed = map_batches(waiting, route, "dim int, row long, vec_id long, v binary, bound long, trees array<string>")
    visits = materialize(routed.select("dim", F.explode("trees").alias("tree"), "row", "vec_id", "v", "bound"), "mtree-visits")
    everything = home.drop("rank").unionByName(_visit(pages, visits, k, top))
    return _ranked(everything, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_inner_products(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The contract's search: queries are the rows whose vec_id is divisible by ``every``."""
    return search(quantize(embeddings.select("vec_id", "embedding")), F.col("vec_id") % every == 0, k)
