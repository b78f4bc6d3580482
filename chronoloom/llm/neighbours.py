"""Approximate nearest neighbours by low-dimensional stable projections.

A few Gaussian (2-stable) projections map every vector to a point whose squared distance to a query's point, divided by
the vectors' squared distance, follows a chi-square law. The points are indexed by a kd-tree of two levels: its upper part
splits the space into cells, by a bounded sample, and every row goes to the block of its cell (to one of several, where a
cell has many rows); its lower part is built over each block by the task that has it. For a query, leaves come in order of
their projected distance and all their vectors are verified by true distance, until the chi-square test holds: a vector as
near as the k-th found would, with probability tau, have come before the next leaf.

Queries are a table like the rows. Each first visits one block of its own cell, which bounds its k-th distance, and then
those other blocks whose cells the same test does not rule out; what a block finds beyond the bound is not put out. Queries
of equal vectors are searched for once. A task holds one block and a batch of queries.

Defined results: vectors that are null, empty, all zero, of another length than the first valid query's, or hold null or
non-finite components take no part; equal distances go to the smaller vec_id; fewer candidates than k give them all; a
vec_id that several rows have counts once for a query, by the nearest of its vectors, is never found by a query of its own,
and is asked for once, by the least of its vectors in binary order; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize

PROJECTIONS = 8
TAU = 0.96
LEAF_ROWS = 96
BLOCK_ROWS = 16_384
#: Cells are made from about so many rows, those whose ids hash lowest; there are at most 2**MOST_LEVELS.
SAMPLE_ROWS, MOST_LEVELS = 50_000, 12
SEED = 10


def chi_square_point(tau: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = tau, for even m."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < tau else (low, mid)
    return high


class KdTree:
    """Leaves of a kd-tree over projected points: the order of rows, and each leaf's bounds."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order, bounds, stack = [], [0], [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            spread = points[rows].max(0) - points[rows].min(0)
            if len(rows) <= leaf_rows or not spread.any():  # equal points stay in one leaf, so that their ties are seen together
                order.append(rows)
                bounds.append(bounds[-1] + len(rows))
                continue
            along = points[rows, spread.argmax()]
            cut = np.partition(along, len(rows) // 2)[len(rows) // 2]
            low = along < cut if (along < cut).any() else along <= cut  # never between equal values
            stack += [rows[~low], rows[low]]
        self.order = np.concatenate(order)
        self.bounds = np.array(bounds)
        sorted_points = points[self.order]
        self.low = np.minimum.reduceat(sorted_points, self.bounds[:-1])
        self.high = np.maximum.reduceat(sorted_points, self.bounds[:-1])

    def leaf_distances(self, point: np.ndarray) -> np.ndarray:
        """Least squared distance of each leaf's box to a point."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


class Cells:
    """The upper part of the tree: 2**levels cells, each a box in the projected space."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels = levels
        width = points.shape[1]
        self.along, self.cut = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
        low, high = np.full((1 << (levels + 1), width), -np.inf), np.full((1 << (levels + 1), width), np.inf)
        rows = {1: np.arange(len(points))}
        for node in range(1, 1 << levels):  # node's halves are 2 * node and 2 * node + 1
            here = points[rows[node]]
            if len(here):
                self.along[node] = (here.max(0) - here.min(0)).argmax()
                self.cut[node] = np.median(here[:, self.along[node]])
            d, c = self.along[node], self.cut[node]
            left = here[:, d] < c
            for half, keep in ((2 * node, left), (2 * node + 1, ~left)):
                rows[half] = rows[node][keep]
                low[half], high[half] = low[node], high[node]
            high[2 * node, d], low[2 * node + 1, d] = c, c
            del rows[node]
        self.low, self.high = low[1 << levels :], high[1 << levels :]

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.along[node]] >= self.cut[node])
        return node - (1 << self.levels)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Least squared distance of each cell to a point."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


class Block:
    """One block's rows, indexed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, waves: np.ndarray):
        self.tree = KdTree(vectors @ waves)
        self.ids, self.vectors, self.waves = ids[self.tree.order], vectors[self.tree.order], waves
        self.distinct = len(np.unique(ids)) == len(ids)  # then no more than the k nearest of a leaf can matter

    def search(self, query: np.ndarray, k: int, point: float, bound: float) -> list[tuple[float, int]]:
        """(distance, vec_id) of the k nearest ids found, none beyond the bound; an id of several vectors counts by its nearest."""
        heap: list[tuple[float, int]] = []
        held: dict[int, float] = {}
        near = self.tree.leaf_distances(query @ self.waves)
        for leaf in np.argsort(near, kind="stable"):
            if near[leaf] > point * bound * bound:
                break
            a, b = self.tree.bounds[leaf], self.tree.bounds[leaf + 1]
            gap = self.vectors[a:b] - query
            found = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            within = np.flatnonzero(found <= bound)
            for j in within[np.lexsort((self.ids[a:b][within], found[within]))][:k] if len(within) > k and self.distinct else within:
                d, i = -float(found[j]), -int(self.ids[a + j])
                if i in held:
                    if d <= held[i]:
                        continue
                    heap.remove((held[i], i))
                    heapq.heapify(heap)
                elif len(heap) == k:
                    if (d, i) <= heap[0]:
                        continue
                    del held[heapq.heappop(heap)[1]]
                heapq.heappush(heap, (d, i))
                held[i] = d
            if len(heap) == k:
                bound = min(bound, -heap[0][0])
        return [(-d, -i) for d, i in heap]


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(usable & F.exists("v", lambda x: x != 0))
    )


def _sample(rows: DataFrame, n: int, waves: np.ndarray) -> np.ndarray:
    """The points of about SAMPLE_ROWS rows, those whose ids hash lowest by remainder; at most twice as many, 64 bytes each."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                points = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) @ waves
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in points], pa.binary())], names=["p"])

    every = max(1, n // SAMPLE_ROWS)
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("v").limit(2 * SAMPLE_ROWS).mapInArrow(project, "p binary")
    found = picked.toArrow().column(0).to_pylist()
    return np.frombuffer(b"".join(found), np.float64).reshape(len(found), -1) if found else np.zeros((1, waves.shape[1]))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _placed(rows: DataFrame, cells: Cells, waves: np.ndarray) -> DataFrame:
    """cell, vec_id, v (binary), q and salt (a running number that spreads the rows of a cell over its blocks)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            if b.num_rows:
                flat = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                salt = np.arange(seen, seen + b.num_rows)
                seen += b.num_rows
                columns = [pa.array(cells.of(flat @ waves)), b.column(0), pa.array([v.tobytes() for v in flat], pa.binary()), b.column(2), pa.array(salt)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "vec_id", "v", "q", "salt"])

    return rows.select("vec_id", "v", "q").mapInArrow(place, "cell long, vec_id long, v binary, q boolean, salt long")


def _visit(blocks: DataFrame, asked: DataFrame, n_blocks: int, waves: np.ndarray, point: float, k: int) -> DataFrame:
    """query_id, vec_id and score of what the queries (block, vec_id, v, bound) find in the blocks that they visit."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, block = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            number, is_query, vec_id, bound = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4))
            vectors, out = _vectors(b.column(3)), []
            cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (is_query[1:] != is_query[:-1])) + 1), b.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if number[x] != at:
                    at, ids, parts, block = number[x], [], [], None
                if not is_query[x]:  # a block's rows come before its queries
                    ids.append(vec_id[x:y])
                    parts.append(vectors[x:y])
                    continue
                if block is None and ids:
                    block, ids, parts = Block(np.concatenate(ids), np.concatenate(parts), waves), [], []
                if block is not None:
                    for i in range(x, y):
                        out += [(int(vec_id[i]), j, d) for d, j in block.search(vectors[i], k, point, float(bound[i]))]
            if out:
                q, j, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(j, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])

    one = blocks.select("block", F.lit(0).alias("is_query"), "vec_id", "v", F.lit(0.0).alias("bound"))
    two = asked.select("block", F.lit(1).alias("is_query"), "vec_id", "v", "bound")
    dealt = one.unionAll(two).repartition(n_blocks, "block").sortWithinPartitions("block", "is_query")
    return dealt.mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(table: DataFrame, is_query, k: int = 10, tau: float = TAU, projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest found of each query row."""
    rows = valid_vectors(table).withColumn("q", F.coalesce(is_query, F.lit(False)))
    first = rows.where("q").orderBy("vec_id").limit(1).collect()
    width = len(first[0]["v"]) if first else 0
    rows = rows.where(F.size("v") == width)
    n = rows.count() if first else 0
    if not n:
        return rows.where(F.lit(False)).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    waves = np.random.default_rng(SEED).standard_normal((width, projections))
    point = chi_square_point(tau, projections)
    levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(n / block_rows)))))
    cells = Cells(_sample(rows, n, waves) if levels else np.zeros((1, projections)), levels)

    placed = materialize(_placed(rows, cells, waves), "placed-vectors")
    held = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2**MOST_LEVELS rows at most
    parts = np.array([-(-held.get(c, 0) // block_rows) for c in range(1 << levels)], np.int64)
    starts = np.concatenate([[0], np.cumsum(parts)])
    n_blocks = int(starts[-1])
    where = placed.sparkSession.createDataFrame([(c, int(starts[c]), int(parts[c])) for c in held], "cell long, first long, parts long")
    blocks = placed.join(F.broadcast(where), "cell").withColumn("block", F.col("first") + F.pmod("salt", "parts"))

    queries = placed.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(queries.groupBy("v").agg(F.min("vec_id").alias("vec_id")), "asked")  # equal vectors are searched for once,
    most = k + 1  # with one more, since each query leaves its own vec_id out
    home = materialize(_homes(asked, cells, waves, starts), "homes")
    near = materialize(_visit(blocks, home.withColumn("bound", F.lit(float("inf"))), n_blocks, waves, point, most), "near-home")
    bounds = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= most, F.max("score")).alias("bound"))  # a block gives that many rows a query at most
    bounded = home.join(bounds, home.vec_id == bounds.query_id, "left").select("vec_id", "v", "block", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = near.unionAll(_visit(blocks, _others(bounded, cells, waves, starts, point), n_blocks, waves, point, most)) if n_blocks > 1 else near
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("score", "vec_id"))
    best = once.withColumn("rank", ranked("query_id")).where(F.col("rank") <= most).select(F.col("query_id").alias("asked"), F.col("vec_id").alias("found"), "score")
    owners = queries.join(asked.select("v", F.col("vec_id").alias("asked")), "v").select(F.col("vec_id").alias("query_id"), "asked")
    pairs = owners.join(best, "asked").where("found <> query_id").select("query_id", F.col("found").alias("vec_id"), "score")
    return pairs.withColumn("rank", ranked("query_id")).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _homes(asked: DataFrame, cells: Cells, waves: np.ndarray, starts: np.ndarray) -> DataFrame:
    """vec_id, v and block: one block of the cell that a query lies in."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = cells.of(_vectors(b.column(1)) @ waves)
                parts = np.maximum(1, starts[cell + 1] - starts[cell])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts[cell] + np.abs(b.column(0).to_numpy()) % parts)], names=["vec_id", "v", "block"])

    return asked.select("vec_id", "v").mapInArrow(home, "vec_id long, v binary, block long")


def _others(asked: DataFrame, cells: Cells, waves: np.ndarray, starts: np.ndarray, point: float) -> DataFrame:
    """The queries once for each block that can hold something nearer than their bound, but for the one visited."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            projected = _vectors(b.column(1)) @ waves
            bound, home = b.column(3).to_numpy(), b.column(2).to_numpy()
            for i in range(b.num_rows):
                near = np.flatnonzero(cells.distances(projected[i]) <= point * bound[i] ** 2) if np.isfinite(bound[i]) else np.arange(len(starts) - 1)
                visits = np.concatenate([np.arange(starts[c], starts[c + 1]) for c in near]) if len(near) else np.empty(0, np.int64)
                visits = visits[visits != home[i]]
                if len(visits):
                    same = pa.array(np.full(len(visits), i))
                    yield pa.RecordBatch.from_arrays([pa.array(visits), *(b.column(c).take(same) for c in (0, 1, 3))], names=["block", "vec_id", "v", "bound"])

    return asked.select("vec_id", "v", "block", "bound").mapInArrow(spread, "block long, vec_id long, v binary, bound double")
