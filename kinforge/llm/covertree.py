"""Exact top-k inner-product search with dual cover trees.

Vectors are dealt to shards; each shard builds a cover tree over its vectors, and each block of queries one over the
queries.  A node has a centre and a covering radius, and its children's centres are a net of a smaller radius.  Over a
pair of nodes no product exceeds <c, d> + r|d| + s|c| + r s (centres c, d, radii r, s), so a pair is left out when that
is below the worst k-th score of the query node's group so far.  What remains at the leaves is multiplied exactly, and
the best k of each query and shard are merged over the shards.

Queries meet the vectors block against block: a grid cell (shard, query block) holds at most one block of each, however
large the tables are.  Components are floor(scale * x) in exact integers.  Vectors that are null, empty or hold a null or
a non-finite component take no part, nor do rows with a null id; only vectors of one length are compared.  Rows with
the query's own id are left out; otherwise repeated rows count each.  Ties go to the smaller id.  Equal vectors share a
node of radius 0, of which k + 1 smallest ids suffice.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import map_batches
from .shards import one
from .textkit import mix

SHARD_BYTES, QUERY_BYTES = 4 << 20, 8 << 20
LEAF, QUERY_LEAF, BASE = 96, 16, 1.4


class CoverTree:
    """Nodes in arrays: centre, radius, point range, child range; points of a node are contiguous in ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.centre, self.radius, self.span, self.kids = [], [], [], []
        if len(points):
            self._add(0, len(points), 0)
            todo = [0]
            while todo:
                todo += self._split(todo.pop())
        self.centre = np.array(self.centre, np.int64)
        self.radius = np.array(self.radius)
        self.norm = np.sqrt((self.points[self.centre] ** 2).sum(1)) if len(points) else np.zeros(0)

    def _add(self, a: int, b: int, centre: int) -> int:
        own = self.points[self.order[a:b]]
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((own - self.points[centre]) ** 2).sum(1).max())))
        self.span.append((a, b))
        self.kids.append(())
        return len(self.span) - 1

    def _split(self, node: int) -> list[int]:
        a, b = self.span[node]
        if b - a <= self.leaf or self.radius[node] == 0:
            return []
        index = self.order[a:b]
        own = self.points[index]
        reach = self.radius[node] / BASE
        centres, which = [self.centre[node]], np.zeros(b - a, np.int64)
        near = ((own - self.points[centres[0]]) ** 2).sum(1)
        while near.max() > reach**2:  # the farthest point becomes a centre until all are within reach
            c = index[int(near.argmax())]
            d = ((own - self.points[c]) ** 2).sum(1)
            closer = d < near
            which[closer], near[closer] = len(centres), d[closer]
            centres.append(c)
            if len(centres) > (b - a) // 4:
                return []  # no structure at this scale: one leaf
        sort = np.argsort(which, kind="stable")
        self.order[a:b] = index[sort]
        cuts = np.searchsorted(which[sort], np.arange(len(centres) + 1))
        kids = [self._add(a + x, a + y, c) for c, x, y in zip(centres, cuts, cuts[1:]) if y > x]
        self.kids[node] = tuple(kids)
        return kids


class _Best:
    """Best k so far of a set of queries."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        useful = (score >= self.score[rows, -1][:, None]).any(0)
        if not useful.any():
            return
        score = np.concatenate((self.score[rows], score[:, useful]), 1)
        ids = np.concatenate((self.id[rows], np.broadcast_to(ids[useful], (len(rows), int(useful.sum())))), 1)
        top = np.lexsort((ids, -score), axis=-1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1)


def dual_tree_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[_Best, dict[str, int]]:
    """Best k products of every query among ``vectors``; and how many point pairs were multiplied of how many."""
    q, r = CoverTree(queries, QUERY_LEAF), CoverTree(vectors)
    best = _Best(len(queries), k)
    stats = {"pairs": len(queries) * len(vectors), "multiplied": 0}
    biggest = max(np.abs(queries).max(initial=0), 1) * max(np.abs(vectors).max(initial=0), 1) * max(queries.shape[1], 1)
    exact = (queries.astype(np.float64), vectors.astype(np.float64)) if biggest < 2**52 else (queries, vectors)
    worst = np.full(len(q.span), -np.inf)  # of each query node, its queries' lowest k-th score

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Upper bounds for all pairs of query nodes ``a`` and vector nodes ``b``, with slack for rounding."""
        inner = q.points[q.centre[a]] @ r.points[r.centre[b]].T
        top = inner + np.outer(q.radius[a], r.norm[b]) + np.outer(q.norm[a], r.radius[b]) + np.outer(q.radius[a], r.radius[b])
        return top + 1e-9 * (np.abs(top) + np.outer(q.norm[a], r.norm[b]) + 1)

    def visit(a: int, b: int, top: float) -> None:
        if top < worst[a]:
            return
        qa, rb = q.kids[a], r.kids[b]
        if not qa and not rb:
            rows = q.order[slice(*q.span[a])]
            cols = r.order[slice(*r.span[b])]
            if r.radius[b] == 0:  # equal vectors: smallest ids win every tie
                cols = cols[np.argsort(ids[cols], kind="stable")[: k + 1 + int((np.bincount(np.unique(ids[cols], return_inverse=True)[1]).max()))]]
            score = exact[0][rows] @ exact[1][cols].T
            stats["multiplied"] += score.size
            score = np.where(query_ids[rows][:, None] == ids[cols][None], -np.inf, score.astype(np.float64))
            best.offer(rows, score, ids[cols])
            worst[a] = best.score[rows, -1].min()
            return
        some_q = np.array(qa) if qa and (not rb or q.radius[a] >= r.radius[b]) else np.array([a])
        some_r = np.array(rb) if rb and not (len(some_q) > 1 or some_q[0] != a) else np.array([b])
        tops = bounds(some_q, some_r)
        for i, x in enumerate(some_q):
            for j in np.argsort(-tops[i], kind="stable"):
                if tops[i, j] < worst[x]:
                    break
                visit(int(x), int(some_r[j]), float(tops[i, j]))
        if len(some_q) > 1 or some_q[0] != a:
            worst[a] = worst[list(qa)].min()

    if len(queries) and len(vectors):
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        visit(0, 0, np.inf)
    return best, stats


def _packed(rows: DataFrame, scale: int, blocks: int, seed: int, key: str) -> DataFrame:
    """(``key``, dim, ids, values): blobs of usable vectors, dealt to ``blocks`` by a hash of the id."""

    def kernel(batch: pa.RecordBatch):
        ids, lists = batch.column(0), batch.column(1)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(sizes)
        wrong = np.concatenate(([0], np.cumsum(bad | ~np.isfinite(x))))
        ok = (wrong[ends] == wrong[ends - sizes]) & (sizes > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        block = (mix(ids.astype(np.uint64) + np.uint64(seed)) % np.uint64(blocks)).astype(np.int64)
        for dim in np.unique(sizes[ok]):
            for b in np.unique(block[ok & (sizes == dim)]):
                own = np.flatnonzero(ok & (sizes == dim) & (block == b))
                values = np.floor(scale * x[(ends - sizes)[own][:, None] + np.arange(dim)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids[own].astype(np.int64).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=[key, "dim", "ids", "values"])

    return map_batches(rows, kernel, f"{key} int, dim int, ids binary, values binary")


def _unpack(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [i for i, d in enumerate(table.column("dim").to_pylist()) if d == dim]
    ids, values = one(table, "ids"), one(table, "values")
    got = np.concatenate([np.frombuffer(ids[i].as_py(), np.int64) for i in rows])
    x = np.concatenate([np.frombuffer(values[i].as_py(), np.int64) for i in rows]).reshape(-1, dim)
    order = np.lexsort((*x.T[:2], got))
    return got[order], x[order]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of each query row of ``vectors`` (vec_id, embedding) against all other rows."""
    total = 8 * int(vectors.agg(F.sum(F.size("embedding"))).first()[0] or 0)
    shards, blocks = 1 + total // shard_bytes, 1 + total // query_bytes
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _packed(rows, scale, shards, 1, "shard").withColumn("block", grid(blocks))
    right = _packed(vectors.where(is_query).select(F.col("vec_id").cast("long"), "embedding"), scale, blocks, 2, "block").withColumn("shard", grid(shards))

    def cell(vectors_: pa.Table, queries_: pa.Table) -> pa.Table:
        out = []
        if vectors_.num_rows and queries_.num_rows:
            for dim in sorted(set(queries_.column("dim").to_pylist()) & set(vectors_.column("dim").to_pylist())):
                query_ids, queries = _unpack(queries_, dim)
                best, _ = dual_tree_search(query_ids, queries, *_unpack(vectors_, dim), k)
                row, place = np.nonzero(best.score > -np.inf)
                out.append((query_ids[row], best.id[row, place], best.score[row, place].astype(np.int64)))
        return pa.table([pa.array(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64)) for i in range(3)], names=["query_id", "vec_id", "score"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_in_memory(rows: list[tuple], is_query, k: int, scale: int = 64) -> list[tuple]:
    """Brute force over (vec_id, list): (query_id, rank, vec_id, score).  For tests."""
    import math

    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in good:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(x) == len(y))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out
