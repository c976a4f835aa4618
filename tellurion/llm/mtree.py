"""Exact top-k search by M-trees.

Rows are dealt to trees of a bounded size, vectors near the same of a few sampled pivots together.  A tree
has pages: leaves of vectors and one level of routing pages over them, each with a pivot, a covering radius
and its distance to the page above; each vector has its distance to its leaf's pivot.  The metric is the
Euclidean distance of vectors lengthened by a component that brings all to one length, where the nearest
are those of the largest inner product.  A tree is first searched for its own queries, which gives each a
least score that its best must reach.  Then every tree whose covering radius allows a higher one is searched
for them too, best pages first; pages and vectors are left out where the stored distances and the triangle
inequality show that none can matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unit_hash, written
from .vectors import Best, distinct_vectors, merged, query_vectors, ranked, slots, valid


@dataclass(frozen=True)
class TreeParams:
    """`tree`: vectors in a tree; `leaf`: vectors in a leaf; `pivots`: sampled to deal rows to trees."""

    tree: int = 4096
    leaf: int = 64
    pivots: int = 64


#: A tree as columns: arrays of numbers, nothing that is run when read.
TREE = "slot int, dim int, n int, vectors binary, starts binary, ids binary, length2 double, leaves binary, reach binary, to_pivot binary, routes binary, radii binary"
ASKS = "center array<double>, radius double, qkeys binary, qvectors binary, floors binary, least long, far double"


@dataclass
class Tree:
    vectors: np.ndarray  # whole numbers
    starts: np.ndarray  # of each vector's ids
    ids: np.ndarray
    length2: float  # the squared length that all are brought to
    leaves: np.ndarray  # rows of first and end vector, pivot, route
    reach: np.ndarray  # of each leaf: radius, distance to the page above
    to_pivot: np.ndarray  # of each vector
    routes: np.ndarray  # pivot of each
    radii: np.ndarray

    def __post_init__(self) -> None:
        self.points = self.vectors.astype(float)
        self.extra = np.sqrt(np.maximum(0, self.length2 - (self.points * self.points).sum(1)))
        self.of_route = [np.flatnonzero(self.leaves[:, 3] == r) for r in range(len(self.routes))]

    def row(self, slot: int) -> dict:
        out = {"slot": slot, "dim": self.vectors.shape[1], "n": len(self.vectors), "length2": self.length2}
        return out | {k: getattr(self, k).tobytes() for k in ("vectors", "starts", "ids", "leaves", "reach", "to_pivot", "routes", "radii")}

    @classmethod
    def of(cls, r) -> Tree:
        whole = lambda x: np.frombuffer(x, dtype="<i8")
        real = lambda x: np.frombuffer(x, dtype="<f8")
        return cls(whole(r.vectors).reshape(r.n, r.dim), whole(r.starts), whole(r.ids), r.length2, whole(r.leaves).reshape(-1, 4), real(r.reach).reshape(-1, 2), real(r.to_pivot), whole(r.routes), real(r.radii))


def _distances(x: np.ndarray, ex: np.ndarray, y: np.ndarray, ey: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T) + (ex[:, None] - ey[None, :]) ** 2
    return np.sqrt(np.maximum(d, 0))


def build_tree(vectors: np.ndarray, ids: list[np.ndarray], length2: float, params: TreeParams = TreeParams()) -> Tree:
    """Loads a tree at once: pivots spread over the rows, each row to its nearest, leaves filled in the
    order of the distance to the pivot."""
    n = len(vectors)
    points = vectors.astype(float)
    extra = np.sqrt(np.maximum(0, length2 - (points * points).sum(1)))
    picks = np.unique(np.linspace(0, n - 1, max(1, n // params.leaf)).astype(int))
    d = _distances(points, extra, points[picks], extra[picks])
    own = d.argmin(axis=1)
    near = d[np.arange(n), own]
    order = np.lexsort((near, own))
    vectors, points, extra, own, near = vectors[order], points[order], extra[order], own[order], near[order]
    ids = [ids[i] for i in order]
    place = np.argsort(order)[picks]  # where the pivots stand now
    leaves, reach = [], []
    for p in range(len(picks)):
        mine = np.flatnonzero(own == p)
        for a in range(0, len(mine), params.leaf):
            part = mine[a : a + params.leaf]
            leaves.append([int(part[0]), int(part[-1]) + 1, int(place[p]), 0])
            reach.append([float(near[part].max()), 0.0])
    leaves, reach = np.array(leaves, dtype="<i8"), np.array(reach, dtype="<f8")
    tops = np.unique(np.linspace(0, len(leaves) - 1, max(1, int(np.sqrt(len(leaves))))).astype(int))
    at = leaves[:, 2]
    d = _distances(points[at], extra[at], points[at[tops]], extra[at[tops]])
    leaves[:, 3] = d.argmin(axis=1)
    reach[:, 1] = d.min(axis=1)
    radii = np.array([(reach[leaves[:, 3] == r].sum(1)).max(initial=0) for r in range(len(tops))])
    starts = np.cumsum([0, *map(len, ids)]).astype("<i8")
    return Tree(vectors, starts, np.concatenate(ids).astype("<i8"), length2, leaves, reach, near, at[tops].astype("<i8"), radii)


def search_tree(tree: Tree, queries: np.ndarray, best: Best) -> None:
    """Adds to `best` what the tree has for the queries (whole numbers)."""
    points = queries.astype(float)
    q2 = (points * points).sum(1)
    zero = np.zeros(len(queries))
    slack = 1e-9 * (q2 + tree.length2) + 1e-9

    def bound(least: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The largest inner product that a distance of at least `least` allows."""
        shape = (-1,) + (1,) * (least.ndim - 1)
        return (q2[which].reshape(shape) + tree.length2 - np.maximum(least, 0) ** 2) / 2 + slack[which].reshape(shape)

    everyone = np.arange(len(queries))
    to_route = _distances(points, zero, tree.points[tree.routes], tree.extra[tree.routes])
    heap = []
    for r, radius in enumerate(tree.radii):
        high = bound(to_route[:, r] - radius, everyone)
        heap.append((-float(high.max()), 0, r, high, None))
    heap.sort(key=lambda x: x[:3])
    while heap:
        _, kind, k, high, to_pivot = heapq.heappop(heap)
        which = np.flatnonzero(high >= best.worst)
        if not len(which):
            continue
        if kind == 0:
            for i in tree.of_route[k]:
                (radius, up), pivot = tree.reach[i], tree.leaves[i, 2]
                # By the stored distance to the page above, before any distance is computed.
                near = which[bound(np.abs(to_route[which, k] - up) - radius, which) >= best.worst[which]]
                if len(near):
                    dist, leaf_high = np.full(len(queries), np.inf), np.full(len(queries), -np.inf)
                    dist[near] = _distances(points[near], zero[near], tree.points[[pivot]], tree.extra[[pivot]])[:, 0]
                    leaf_high[near] = bound(dist[near] - radius, near)
                    heapq.heappush(heap, (-float(leaf_high.max()), 1, int(i), leaf_high, dist))
        else:
            a, b = tree.leaves[k, :2]
            may = bound(np.abs(to_pivot[which][:, None] - tree.to_pivot[None, a:b]), which) >= best.worst[which][:, None]
            cols = a + np.flatnonzero(may.any(axis=0))
            which = which[may.any(axis=1)]
            if len(cols) and len(which):
                times = tree.starts[cols + 1] - tree.starts[cols]
                ids = np.concatenate([tree.ids[tree.starts[c] : tree.starts[c + 1]] for c in cols])
                best.add(which, np.repeat(whole_products(queries[which], tree.vectors[cols]), times, axis=1), ids)


#: The largest score: of a product beyond it in either direction the score is this number, with its sign.
LARGEST = 2**63 - 1


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held within the range of a long."""
    size = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if size < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if size < 2.0**62:
        return a @ b.T
    found = a.astype(object) @ b.astype(object).T
    return np.clip(found, -LARGEST, LARGEST).astype(np.int64)


def exact_top(embeddings: DataFrame, every: int = 20, top: int = 20, scale: int = 64, params: TreeParams = TreeParams(), key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Of each row whose id is divisible by `every`: query_id, rank, vec_id, score of the `top` rows with
    the largest inner product of floor(scale * x), ties to the smaller id.

    Vectors that are null or hold nulls or non-finite numbers take no part, nor do rows without an id.
    Vectors are compared with those of as many dimensions; those without any have score 0 with one another.
    Rows with the query's id are its own; equal rows count once.  Components and scores are exact up to the
    range of a long and stay at its limits beyond; ties there go to the smaller id too."""
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & valid(F.col("vec"), empty=True))
    # floor gives longs and stays at their limits; the least of them has no opposite.
    whole = F.transform("vec", lambda x: F.greatest(F.floor(x * F.lit(float(scale))).cast("long"), F.lit(-LARGEST)))
    rows = written(rows.select("id", whole.alias("vec")), "vectors")
    is_query, keep = F.pmod("id", F.lit(every)) == 0, top + 1
    queries = written(query_vectors(rows, is_query), "queries")
    index = written(distinct_vectors(rows, keep).join(queries, "vec", "left"), "index")
    square = F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    n, longest = index.agg(F.count("*"), F.max(square)).first()
    length2 = float(longest or 0.0)
    some = [np.array(r["vec"], dtype=float) for r in index.where(unit_hash(F.col("ids").cast("string")) < 2.0 * params.pivots / max(n, 1)).select("vec").orderBy("vec").limit(params.pivots).collect()]

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, far = np.zeros(len(batch), dtype=int), np.zeros(len(batch))
            lengths = batch["vec"].map(len).to_numpy()
            for dim in np.unique(lengths):
                same = [p for p in some if len(p) == dim]
                at = np.flatnonzero(lengths == dim)
                if same:
                    x = np.array(list(batch["vec"].iloc[at]), dtype=float).reshape(len(at), dim)
                    d = _distances(x, np.zeros(len(x)), np.array(same), np.zeros(len(same)))
                    own[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield batch.assign(pivot=own, far=far)

    parts = max(1, -(-n // params.tree))
    index = index.withColumn("asks", F.col("qkey").isNotNull()).withColumn("qkey", F.coalesce("qkey", F.lit(0)))
    near = index.mapInPandas(dealt, "vec array<long>, ids array<long>, qkey long, asks boolean, pivot int, far double")
    near = near.repartitionByRange(parts, "pivot", "far", "ids").sortWithinPartitions("pivot", "far", "ids")

    def planted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Trees, each with what it has found for its own queries: the least score that counts for them."""
        task = TaskContext.get().partitionId()
        for k, part in enumerate(slots(batches, params.tree)):
            dim = len(part["vec"].iloc[0])
            vectors = np.array(list(part["vec"]), dtype="<i8").reshape(len(part), dim)
            tree = build_tree(vectors, [np.asarray(x, dtype=np.int64) for x in part["ids"]], length2, params)
            mine = part["asks"].to_numpy(dtype=bool)
            asks, qkeys = vectors[mine], part["qkey"].to_numpy("<i8")[mine]
            best = Best(len(asks), keep, np.int64)
            if len(asks):
                search_tree(tree, asks, best)
            # The tree's middle and how far its vectors reach; the queries' reach has no further component.
            center = tree.points.mean(axis=0)
            middle, one = float(tree.extra.mean()), np.zeros(len(asks))
            radius = float(_distances(tree.points, tree.extra, center[None, :], np.array([middle])).max(initial=0))
            far = float(_distances(asks.astype(float), one, center[None, :], np.zeros(1)).max(initial=0)) if len(asks) else 0.0
            more = {"center": [*center.tolist(), middle], "radius": radius, "qkeys": qkeys.tobytes(), "qvectors": asks.tobytes(), "floors": best.worst.tobytes(), "least": int(best.worst.min(initial=LARGEST)), "far": far}
            yield pd.DataFrame([tree.row(task * 65536 + k) | more])

    trees = written(near.mapInPandas(planted, f"{TREE}, {ASKS}"), "trees")
    # Blocks of the stated queries, each with the trees that can hold one of its best.
    asks = trees.where(F.length("qkeys") > 0).select("dim", F.col("center").alias("from"), "far", "qkeys", "qvectors", "floors", "least")
    aims = trees.select("slot", "dim", "center", "radius")
    gap2 = F.aggregate(F.zip_with(F.slice("from", 1, F.col("dim")), F.slice("center", 1, F.col("dim")), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) + F.pow(F.element_at("center", -1), F.lit(2.0))
    from2 = F.aggregate(F.slice("from", 1, F.col("dim")), F.lit(0.0), lambda a, x: a + x * x)
    longest2 = F.pow(F.sqrt(from2) + F.col("far"), F.lit(2.0))  # of a query's squared length
    least_gap = F.greatest(F.sqrt(gap2) - F.col("far") - F.col("radius"), F.lit(0.0))
    high = (longest2 + F.lit(length2) - least_gap * least_gap) / 2 + F.lit(1e-9) * (longest2 + F.lit(length2)) + F.lit(1e-9)
    asks = asks.join(aims, "dim").where(high >= F.col("least").cast("double")).select("slot", "dim", "qkeys", "qvectors", "floors")

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                qkeys = np.frombuffer(r.qkeys, dtype="<i8")
                best = Best(len(qkeys), keep, np.int64, np.frombuffer(r.floors, dtype="<i8"))
                search_tree(Tree.of(r), np.frombuffer(r.qvectors, dtype="<i8").reshape(len(qkeys), r.dim), best)
                yield best.rows(qkeys)

    found = asks.join(trees.select(*[c.split()[0] for c in TREE.split(", ")]), ["slot", "dim"]).mapInPandas(searched, "qkey long, scores array<long>, ids array<long>")
    return ranked(merged(found, keep), rows, is_query, queries, top)


def op10_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top(table(spark, sf_dir, "embeddings"))


#: DuckDB SQL for the same rows.
ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
