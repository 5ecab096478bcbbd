"""Approximate nearest neighbours by largest inner product, with a forest of random-projection trees.

Vectors of any length are put on a sphere (one more component fills them up to the longest), where the largest
inner product is the smallest angle. Each tree splits a bounded sample (`sample` vectors, those with the smallest
hash of vec_id) at the median of random directions, as deep as leaves of some `leaf` vectors of the whole table need (but
for leaves of under eight vectors of the sample); every vector is then indexed in each
tree. A query walks all trees through one priority queue, nearest border first (the squares of the margins on the way
are summed, as random directions are nearly at right angles), until it has `visits` leaves: as
many as find the share `recall` of the true neighbours of 128 vectors of the sample within it, if not given.
Leaves are blocks of vectors: a leaf with more than `block` is split, and its queries go to each part; in a part
the queries' scores are one matrix product; all that reach the k-th, ties included, are scored exactly, and the best `k` go
on to the final ranking.

Equal vectors are one: of each, only the `k` + 1 smallest vec_ids can be in a result, and the window that finds
them limits each key before the exchange, so that a vector which a third of all rows share is no task's burden.

Cases: vectors that are null or zero, or hold null or non-finite components, and rows with a null vec_id, take no
part, nor do vectors whose dimension is not the commonest (of ties the smaller); repeated rows (the same vec_id) count
once; ties of the score go to the smaller vec_id; with fewer candidates than `k` all are returned; an empty table gives an
empty result; vectors of any length are taken whole; extra columns, of whatever names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabveil.llm.common import only, written


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Tree:
    """Inner nodes: direction, threshold, children; children under 0 are leaves (~number)."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        self.directions, self.thresholds, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(points, np.arange(len(points)), leaf, rng)
        self.directions = np.array(self.directions, np.float32).reshape(-1, points.shape[1])
        self.thresholds, self.children = np.array(self.thresholds), np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, points: np.ndarray, own: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(own) > leaf:
            for _ in range(3):
                a, b = points[rng.choice(own, 2, replace=False)]
                direction = (a - b) / (np.linalg.norm(a - b) or 1)
                margin = points[own] @ direction
                at = float(np.median(margin))
                low = margin < at
                if 0.2 < low.mean() < 0.8:
                    node = len(self.thresholds)
                    self.directions.append(direction)
                    self.thresholds.append(at)
                    self.children.append((0, 0))
                    self.children[node] = (self._grow(points, own[low], leaf, rng), self._grow(points, own[~low], leaf, rng))
                    return node
        self.leaves += 1
        return ~(self.leaves - 1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while len(inner := np.flatnonzero(at >= 0)):
            n = at[inner]
            right = (x[inner] * self.directions[n]).sum(1) >= self.thresholds[n]
            at[inner] = self.children[n, right.astype(int)]
        return ~at


def search(trees: list[Tree], q: np.ndarray, visits: int) -> list[list[tuple[int, int]]]:
    """For each query the (tree, leaf) that one queue over all trees gives first, the nearest margin first."""
    margins = [q @ t.directions.T - t.thresholds for t in trees]
    out = []
    for i in range(len(q)):
        queue = [(0.0, k, int(t.root)) for k, t in enumerate(trees)]
        found: list[tuple[int, int]] = []
        while queue and len(found) < visits:
            far, k, node = heapq.heappop(queue)
            while node >= 0:
                m = float(margins[k][i, node])
                near, other = trees[k].children[node][:: -1 if m >= 0 else 1]
                heapq.heappush(queue, (far + m * m, k, int(other)))
                node = int(near)
            found.append((k, ~node))
        out.append(found)
    return out


def visits_for(trees: list[Tree], points: np.ndarray, k: int, recall: float, asked: int = 128) -> int:
    """How many leaves find the share `recall` of the k nearest points of the first `asked` points."""
    q = points[:asked]
    near = q @ points.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argsort(-near, axis=1)[:, :k][:, : max(0, len(points) - 1)]
    order = search(trees, q, sum(t.leaves for t in trees))
    leaf = np.stack([t.leaf_of(points) for t in trees], 1)
    at = []
    for i, found in enumerate(order):
        place = {x: n for n, x in enumerate(found)}
        at += [min(place[t, int(c)] for t, c in enumerate(leaf[j])) for j in true[i]]
    return 1 + int(np.quantile(at, recall, method="higher")) if at else 1


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def neighbours(vectors: DataFrame, queries: Column, k: int = 20, trees: int = 3, leaf: int = 512, visits: int | None = None, recall: float = 0.95, sample: int = 65536, block: int = 4096, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score. queries: a condition on vec_id."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = only(vectors, vec_id="vec_id", v="embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if not dims:
        return empty
    dim = dims["d"]
    ids = Window.partitionBy("v").orderBy("vec_id")
    once = rows.where(F.size("v") == dim).withColumn("r", F.row_number().over(ids)).where(F.col("r") <= k + 1)
    # A vec_id twice with two vectors counts with each; with the same vector, once.
    distinct = written(once.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "vectors")
    asked = written(rows.where((F.size("v") == dim) & queries).dropDuplicates(["vec_id"]), "queries")
    norm, total = distinct.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.count("*")).first()
    fit = distinct.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("v").toArrow()

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x / norm
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], 1).astype(np.float32)

    points, rng = lifted(_matrix(fit.column("v"), dim)), np.random.default_rng(seed)
    # Of the k nearest of all, the sample has its share.
    share = len(points) / max(total, 1)
    grown = [Tree(points, max(8, int(leaf * share)), rng) for _ in range(trees)]
    visits = visits or visits_for(grown, points, max(1, math.ceil(k * share)), recall)
    forest = spark.sparkContext.broadcast(grown)  # bounded by sample / leaf

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 2000):
                part = b.slice(low, 2000)
                x = lifted(_matrix(part.column(0), dim))
                for t, tree in enumerate(forest.value):
                    cell = tree.leaf_of(x) + (t << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), part.column(0), part.column(1)], ["cell", "v", "ids"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 200):
                part = b.slice(low, 200)
                x = _matrix(part.column(1), dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                found = search(forest.value, np.concatenate([x, np.zeros((len(x), 1))], 1).astype(np.float32), visits)
                at = pa.array(np.repeat(np.arange(len(x)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array([(t << 32) + c for f in found for t, c in f], pa.int64()), part.column(0).take(at), part.column(1).take(at)], ["cell", "query_id", "q"])

    cells = distinct.mapInArrow(index, "cell long, v array<double>, ids array<long>")
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    left = cells.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    right = asked.mapInArrow(visit, "cell long, query_id long, q array<double>").join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def best(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        """For each query of a part its k best: one row with two lists."""
        names, kinds = ["query_id", "vec_ids", "scores"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            x, ids, q, query = _matrix(a.column("v"), dim), a.column("ids").to_pylist(), _matrix(b.column("q"), dim), b.column("query_id").to_pylist()
            for low in range(0, len(q), 256):
                rough = q[low : low + 256] @ x.T
                # k + 1 vectors have k ids besides the query's own; what ties with the last of them, but for rounding, counts too.
                n = min(k + 1, len(x))
                least = -np.partition(-rough, n - 1, axis=1)[:, n - 1] - 1e-9 * np.abs(rough).max(axis=1)
                for i in range(len(rough)):
                    own = np.flatnonzero(rough[i] >= least[i])
                    me, score = query[low + i], (x[own] * q[low + i]).sum(1)
                    found = sorted((-s, v) for s, j in zip(score.tolist(), own.tolist(), strict=True) for v in ids[j] if v != me)[:k]
                    out.append((me, [v for _, v in found], [-s for s, _ in found]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=names)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        """At most `visits` * parts lists of k."""
        found = {v: s for vs, ss in zip(table.column("vec_ids").to_pylist(), table.column("scores").to_pylist(), strict=True) for v, s in zip(vs, ss, strict=True)}
        top = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
        columns = [[key[0].as_py()] * len(top), list(range(1, len(top) + 1)), [v for v, _ in top], [s for _, s in top]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    found = left.select("cell", "part", "v", "ids").groupBy("cell", "part").cogroup(right.select("cell", "part", "query_id", "q").groupBy("cell", "part")).applyInArrow(best, "query_id long, vec_ids array<long>, scores array<double>")
    return found.groupBy("query_id").applyInArrow(merged, "query_id long, rank int, vec_id long, score double")
