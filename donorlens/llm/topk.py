"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt into shards of about ``shard_rows`` by the hash of their row
number, so a repeated id is spread like any others.
Each shard builds a KD-tree: median splits along the widest side of the tight
bounding box, down to ``leaf_rows``.  A query walks a tree best box first: the
inner product of q with any point of a box is at most
sum(max(q * low, q * high)), and boxes below the k-th score known so far are
left out.  Queries first search one shard; that k-th score is then propagated
to their search of all other shards.  Queries travel in blocks of
``query_rows``, so a task holds one shard and one block.

Components become floor(64 * x); sums are exact in 64-bit floats as long as
dimension * max**2 stays below 2**53, in 64-bit integers beyond.  Components
beyond 2**62, and vectors whose products could leave 64 bits, are an error:
their score is no long.

Defined results: null vectors and vectors that hold a null or non-finite
component take no part, nor do rows with a null vec_id; only vectors of equal
length are compared; rows that repeat a vec_id are candidates, and queries, of
their own (a query leaves out its own row only); empty vectors have score 0
with each other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.common import written

SCALE = 64


class KdTree:
    """Tree over integer points; nodes in arrays, points ordered by leaf."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf_rows: int):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.points = rows[order], ids[order], points[order]
        self.low, self.high, self.span, self.child, self.least = [], [], [], [], []
        self._split(0, len(ids), leaf_rows)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, start: int, end: int, leaf_rows: int) -> int:
        node, part = len(self.span), self.points[start:end]
        self.low.append(part.min(axis=0))
        self.high.append(part.max(axis=0))
        self.span.append((start, end))
        self.least.append(int(self.ids[start:end].min()))
        self.child.append(None)
        if end - start > leaf_rows and part.shape[1]:
            axis = int(np.argmax(self.high[node] - self.low[node]))
            order = np.argsort(part[:, axis], kind="stable")  # ties stay in id order
            for of in (self.points, self.ids, self.rows):
                of[start:end] = of[start:end][order]
            middle = (start + end) // 2
            self.child[node] = (self._split(start, middle, leaf_rows), self._split(middle, end, leaf_rows))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, node): the largest inner product any point of the box can have."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best points other than row ``own`` that score
        at least ``floor``; ties to smaller ids."""
        scores, ids = np.zeros(0, self.points.dtype), np.zeros(0, np.int64)
        kth, kth_id = floor, np.inf
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if -bound == kth and self.least[node] > kth_id:
                continue
            if self.child[node]:
                for c in self.child[node]:
                    if bounds[c] >= kth:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            start, end = self.span[node]
            found = self.points[start:end] @ query
            near = np.flatnonzero((found >= kth) & (self.rows[start:end] != own))
            if not len(near):
                continue
            scores, ids = np.concatenate((scores, found[near])), np.concatenate((ids, self.ids[start:end][near]))
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            if len(ids) == k:
                kth, kth_id = scores[-1], ids[-1]
        return scores, ids


def _exact(most: int) -> type:
    """A type that holds inner products up to ``most`` exactly."""
    if most >= 2**63:
        raise ValueError("vectors whose inner products may leave 64 bits")
    return np.float64 if most < 2**53 else np.int64


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows as a matrix of exact numbers."""
    rows = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False)
    matrix = values.reshape(rows, -1) if rows else values.reshape(0, 0)
    most = int(np.abs(matrix).max(initial=0))
    return matrix.astype(_exact(most * most * max(matrix.shape[1], 1)))


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return a.astype(_exact(most)), b.astype(_exact(most))


def _build(leaf_rows: int, k: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        """One shard: its tree, and its own queries with their k-th score here."""
        group = group.combine_chunks()
        rows, ids = group.column("row").to_numpy(), group.column("vec_id").to_numpy()
        points = _matrix(group.column("v").chunk(0))
        tree = KdTree(rows, ids, points, leaf_rows)
        asked = np.flatnonzero(group.column("is_query").to_numpy(zero_copy_only=False))
        bounds = tree.bounds(points[asked])
        kth = []
        for at, bound in zip(asked, bounds, strict=True):
            scores, _ = tree.search(points[at], int(rows[at]), bound, k, -np.inf)
            kth.append(int(scores[-1]) if len(scores) == k else None)
        return pa.table({
            "dim": pa.array([points.shape[1]], pa.int32()), "shard": group.column("shard").slice(0, 1),
            "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary()),
            "query_rows": pa.array([rows[asked].tolist()], pa.list_(pa.int64())), "kth": pa.array([kth], pa.list_(pa.int64()))})

    return run


def _block(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    content = (group.column("row").to_numpy(), group.column("vec_id").to_numpy(), _matrix(group.column("v").chunk(0)), group.column("kth").to_pylist())
    return pa.table({"dim": group.column("dim").slice(0, 1), "block": group.column("block").slice(0, 1), "queries": pa.array([pickle.dumps(content, protocol=5)], pa.binary())})


def _search(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree_bytes, block_bytes in zip(batch.column("tree"), batch.column("queries"), strict=True):
                tree, (rows, ids, points, kth) = pickle.loads(tree_bytes.as_py()), pickle.loads(block_bytes.as_py())
                points, tree.points = _common(points, tree.points)
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for i, bound in enumerate(tree.bounds(points)):
                    found.append(tree.search(points[i], int(rows[i]), bound, k, -np.inf if kth[i] is None else kth[i]))
                sizes = [len(f[1]) for f in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(rows, sizes), pa.int64()), pa.array(np.repeat(ids, sizes), pa.int64()), pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                    pa.array(np.concatenate([f[0] for f in found]).astype(np.int64), pa.int64())], ["row", "query_id", "vec_id", "score"])

    return run


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v array<long>) of the vectors that take part."""
    sound = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
             & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))

    def component(x: Column) -> Column:
        scaled = x.cast("double") * SCALE
        return F.when(F.abs(scaled) < 2.0**62, F.floor(scaled).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))

    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where(sound).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("embedding", component).alias("v")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = 8192, leaf_rows: int = 256, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors."""
    rows = written(integer_vectors(vectors).withColumn("is_query", is_query).withColumn("dim", F.size("v")), "vectors")
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q"))
    plan = dims.select(F.col("dim").alias("plan_dim"), F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("q") / query_rows).cast("int").alias("blocks"))
    rows = rows.join(plan, F.col("dim") == F.col("plan_dim"))
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    trees = written(placed.select("dim", "shard", "row", "vec_id", "v", "is_query").groupBy("dim", "shard")
                    .applyInArrow(_build(leaf_rows, k), "dim int, shard int, tree binary, query_rows array<long>, kth array<long>"), "trees")
    known = trees.select(F.explode(F.arrays_zip("query_rows", "kth")).alias("x")).select(F.col("x.query_rows").alias("known_row"), F.col("x.kth").alias("kth"))
    asked = (rows.where("is_query").join(known, F.col("row") == F.col("known_row"))
             .withColumn("block", F.pmod(F.xxhash64(F.lit(7), "row"), F.col("blocks")).cast("int")))
    blocks = (asked.select("dim", "block", "row", "vec_id", "v", "kth").groupBy("dim", "block").applyInArrow(_block, "dim int, block int, queries binary"))
    # the stated query set, block by block, against every shard of its dimension
    dealt = (blocks.join(plan, F.col("dim") == F.col("plan_dim"))
             .select(F.col("dim").alias("block_dim"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("block_shard"), "block", "queries"))
    met = (trees.select("dim", "shard", "tree")
           .join(dealt, (F.col("dim") == F.col("block_dim")) & (F.col("shard") == F.col("block_shard"))).select("tree", "queries"))
    found = met.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
