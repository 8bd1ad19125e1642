"""Exact top-k inner products with KD-trees, one tree a shard.

Vectors are dealt to shards by a hash. A shard's tree splits at the median of its widest dimension; every node has
the tight box of its vectors and their smallest id. Queries go through a tree in blocks, best first: of all nodes whose box
was looked at, the one with the largest inner product that it allows a query of the block is next, and only those
queries enter it whose k best it can still change. The kth score is carried from shard to shard: each query first meets the
shard it belongs to, and what it found there bounds the search in all others.

A shard and a slab of queries, both of bounded size, are a group of the cluster: a tree is built once for a slab, and the
queries, not the products, are what is sent around. In few dimensions, or with clustered vectors, most nodes are passed
over. In dozens of dimensions boxes of independent components allow nearly everything; then all products are computed,
as matrix products of a leaf and a block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.plans.shared import stage

#: Vectors of a shard and queries of a slab (at most, about); vectors of a leaf and queries of a block.
SHARD, SLAB, LEAF, BLOCK = 65536, 65536, 256, 256
#: Shards that a smaller table has, at most, so that more than one task works on it; vectors of such a shard at least.
LEAST_SHARDS, LEAST = 32, 1024
NOTHING = -(2**62)


def quantised(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null if the vector, or a component, is null or not finite."""
    ok = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Tree:
    """A KD-tree over integer vectors, as arrays: node 0 is the root, children of a node stand side by side."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order, nodes, todo = np.arange(len(ids)), [], [(0, len(ids))]
        self.child: list[int] = []
        at = 0
        while at < len(todo):
            lo, hi = todo[at]
            own = order[lo:hi]
            low, high = vectors[own].min(axis=0), vectors[own].max(axis=0)
            nodes.append((lo, hi, low, high, ids[own].min()))
            wide = int(np.argmax(high - low)) if len(low) else 0
            if hi - lo > leaf and len(low) and high[wide] > low[wide]:
                mid = (hi - lo) // 2
                order[lo:hi] = own[np.argpartition(vectors[own, wide], mid)]
                self.child.append(len(todo))
                todo += [(lo, lo + mid), (lo + mid, hi)]
            else:
                self.child.append(-1)
            at += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.lo, self.hi = (np.array([n[i] for n in nodes]) for i in (0, 1))
        self.low, self.high = (np.stack([n[i] for n in nodes]) for i in (2, 3))
        self.least = np.array([n[4] for n in nodes])
        self.visited = 0

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best of each query (ids ``own`` do not count), best first, ties to smaller ids; ``NOTHING``
        where there are fewer, or none that reaches the query's floor."""
        n = len(queries)
        scores, ids = np.full((n, k), NOTHING, queries.dtype), np.full((n, k), 2**62)
        least = floors.astype(queries.dtype)  # what a score must reach
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        root = up @ self.high[0] + down @ self.low[0]
        todo = [(-root.max(), 0, np.arange(n), root)]
        while todo:
            _, node, rows, bound = heapq.heappop(todo)
            # a bound equal to the kth score is of use for a smaller id only
            enter = (bound > least[rows]) | (bound == least[rows]) & ((scores[rows, -1] < least[rows]) | (self.least[node] < ids[rows, -1]))
            rows = rows[enter]
            if not len(rows):
                continue
            child = self.child[node]
            if child >= 0:
                for c in (child, child + 1):
                    reach = up[rows] @ self.high[c] + down[rows] @ self.low[c]
                    heapq.heappush(todo, (-reach.max(), c, rows, reach))
                continue
            lo, hi = self.lo[node], self.hi[node]
            self.visited += (hi - lo) * len(rows)
            found = queries[rows] @ self.vectors[lo:hi].T
            found[own[rows][:, None] == self.ids[lo:hi]] = NOTHING
            some = (found.max(axis=1) >= least[rows]).nonzero()[0]
            rows, found = rows[some], found[some]
            if not len(rows):
                continue
            both = np.concatenate([scores[rows], found], axis=1)
            named = np.concatenate([ids[rows], np.broadcast_to(self.ids[lo:hi], found.shape)], axis=1)
            best = np.lexsort((named, -both), axis=1)[:, :k]
            scores[rows], ids[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(named, best, 1)
            least[rows] = np.maximum(least[rows], scores[rows, -1])
        return np.where(scores >= floors[:, None].astype(queries.dtype), scores, NOTHING), ids


def _packed(column: Column, size: int, kind: str) -> Column:
    """A bigint array as the bytes of ``size`` integers, zeros after the last one."""

    def run(values: pa.Array) -> pa.Array:
        cuts, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False).astype(kind)
        lens = np.diff(cuts)
        out = np.zeros((len(lens), size), kind)
        out[np.arange(size) < lens[:, None]] = flat[cuts[0] : cuts[-1]]
        return pa.array([row.tobytes() for row in out], pa.binary())

    return F.arrow_udf(run, "binary")(column)


def _matrix(column: pa.ChunkedArray, size: int, kind: str, work: str) -> np.ndarray:
    data = b"".join(x.as_py() for x in column)
    return np.frombuffer(data, kind).reshape(-1, size).astype(work)


def _search(k: int, size: int, kind: str, work: str, leaf: int, block: int):
    """One shard and one slab of queries: the shard's candidates for each query."""

    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], []]
        if points.num_rows and asked.num_rows:
            tree = Tree(points.column("vec_id").to_numpy(), _matrix(points.column("v"), size, kind, work), leaf)
            own, queries, floors = asked.column("vec_id").to_numpy(), _matrix(asked.column("v"), size, kind, work), asked.column("bound").to_numpy()
            # neighbours in direction share a block: they reach for the same nodes
            order = np.lexsort((own, queries.argmax(axis=1) if size else own))
            for i in range(0, len(own), block):
                rows = order[i : i + block]
                scores, ids = tree.search(queries[rows], own[rows], floors[rows], k)
                row, at = np.nonzero(scores > NOTHING)
                for o, x in zip(out, (own[rows][row], ids[row, at], scores[row, at].astype(np.int64)), strict=True):
                    o.append(x)
        return pa.table({c: pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for c, o in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard: int = SHARD, slab: int = SLAB, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """The k highest inner products of each query of ``vectors(vec_id, embedding)``: (query_id, rank, vec_id, score).

    Components x become floor(scale * x). Queries are the rows whose vec_id is divisible by ``every``; candidates all rows
    but those with the query's vec_id. Ranks start at 1, ties go to the smaller vec_id; a query with fewer than k
    candidates has them all. Vectors that are null, hold a null or non-finite component, or have a null vec_id, take no
    part. Rows that repeat a vec_id are each candidates; as queries, the one with the smallest vector (component by
    component) asks. A shorter vector counts as one with zeros after its last component. Other columns are not looked
    at. No rows give no rows. Sums are exact while they stay below 2 ** 63.
    """
    points = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(scale=scale).alias("q")).where("vec_id is not null and q is not null")
    largest = F.max(F.greatest(-F.coalesce(F.array_min("q"), F.lit(0)), F.coalesce(F.array_max("q"), F.lit(0))))
    total, size, top = points.agg(F.count("*"), F.max(F.size("q")), largest).first()
    found = "query_id long, vec_id long, score long"
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    work = "f8" if max(1, size) * top * top < 2**53 else "i8"
    shards = max(-(-total // shard), min(LEAST_SHARDS, total // LEAST), 1)
    slabs = -(-total // every // slab) or 1
    points = points.select("vec_id", "q", _packed(F.col("q"), size, kind).alias("v"), F.pmod(F.xxhash64("vec_id", "q"), F.lit(shards)).cast("long").alias("shard"))
    asked = points.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("q", "v", "shard")).alias("m"))
    asked = asked.select("vec_id", "m.v", F.col("m.shard").alias("home"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slabs)).cast("long").alias("slab"))
    asked, points = stage(asked, "asked"), stage(points.select("vec_id", "v", "shard"), "points")
    many = points.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)).cast("array<long>"))) if slabs > 1 else points.withColumn("slab", F.lit(0).cast("long"))

    def searched(queries: DataFrame) -> DataFrame:
        sides = many.groupBy("shard", "slab"), queries.select("shard", "slab", "vec_id", "v", "bound").groupBy("shard", "slab")
        return sides[0].cogroup(sides[1]).applyInArrow(_search(k, size, kind, work, leaf, block), found)

    first = stage(searched(asked.withColumns({"shard": F.col("home"), "bound": F.lit(NOTHING)})), "home")
    floors = first.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("c")).where(f"c = {k}").select(F.col("query_id").alias("vec_id"), "bound")
    others = asked.join(floors, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(NOTHING)))
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).where("shard <> home")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.union(searched(others)).withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
