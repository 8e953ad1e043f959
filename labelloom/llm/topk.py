"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into blocks. A block keeps one list for each dimension, sorted by the component. A query walks
all lists at once, from the end its own component favours, and scores each row when it first sees it. The components
at the present depth bound the score of every row not yet seen, so the walk ends when that bound is below the k-th
best score. The best of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelloom.llm.vectors import matrix, usable

BLOCK, QUERIES = 8192, 1024
FIRST_STEP = 32
#: Sums of products below this are exact in double precision.
EXACT = 2**53
LARGEST = 2**63 - 1


class SortedLists:
    """The rows of a block (ids, integer components) with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        # Of equal vectors only the k + 1 smallest ids can be among a query's k best others.
        _, group = np.unique(x, axis=0, return_inverse=True)
        order = np.argsort(group.ravel(), kind="stable")
        g = group.ravel()[order]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        nth = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        keep = np.sort(order[nth <= k])
        self.ids, self.x = ids[keep], x[keep]
        self.order = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)
        self.largest = int(np.abs(self.x).max(initial=0))

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of the k best rows other than ``own``, and how many rows were scored."""
        n = len(self.ids)
        exact = self.largest * int(np.abs(query).max(initial=0)) * len(query) < EXACT
        kind = float if exact else object
        x, q = self._as(kind), query.astype(kind)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        scored, depth, step = np.zeros(n, bool), 0, FIRST_STEP
        scores, ids = np.empty(0, kind), np.empty(0, np.int64)
        while depth < n:
            to = min(n, depth + step)
            seen = np.zeros(n, bool)
            seen[self.order[n - to : n - depth, up]] = True
            seen[self.order[depth:to, down]] = True
            if not len(up) and not len(down):
                seen[:] = True
            new = np.flatnonzero(seen & ~scored)
            scored[new] = True
            if len(new):
                got = x[new] @ q
                other = self.ids[new] != own
                scores, ids = np.append(scores, got[other]), np.append(ids, self.ids[new][other])
                top = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[top], ids[top]
            depth, step = to, step * 2
            if depth < n and len(scores) == k:
                bound = self.sorted[n - 1 - depth, up].astype(kind) @ q[up] + self.sorted[depth, down].astype(kind) @ q[down]
                if scores[-1] > bound:  # a tie could still be won by a smaller id
                    break
            if scored.all():
                break
        if not exact:  # scores beyond a long become the largest
            scores = np.array([max(-LARGEST, min(LARGEST, s)) for s in scores], object)
        return scores.astype(np.int64), ids, int(scored.sum())

    def _as(self, kind: type) -> np.ndarray:
        if getattr(self, "_kind", None) is not kind:
            self._kind, self._typed = kind, self.x.astype(kind)
        return self._typed


def block_best(rows: pa.Table, k: int) -> pa.Table:
    """Every query's k best rows within one block of candidates."""
    is_query = rows.column("is_query")
    asked, given = rows.filter(is_query), rows.filter(pa.compute.invert(is_query))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if asked.num_rows and given.num_rows:
        lists = SortedLists(given.column("vec_id").to_numpy(), matrix(given.column("x"), np.int64), k)
        for own, q in zip(asked.column("vec_id").to_numpy(), matrix(asked.column("x"), np.int64)):
            scores, ids, _ = lists.best(q, own, k)
            out.append((np.full(len(ids), own), ids, scores))
    columns = [np.concatenate(c) for c in zip(*out)] or [np.empty(0, np.int64)] * 3
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))


def top_inner_products(candidates: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, per_query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best candidates other than itself (by id).

    Both tables have ``vec_id`` and ``x``, an array of whole numbers. Only vectors of one length compare. Ties go to the
    smaller id. A query whose row repeats is answered once. Rows without an id take no part.
    """
    candidates, queries = (t.select("vec_id", "x", F.size("x").alias("dims")).where("vec_id IS NOT NULL") for t in (candidates, queries))
    queries = queries.distinct()
    blocks = -(-max(1, candidates.count()) // block)
    query_blocks = -(-max(1, queries.count()) // per_query_block)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def one(n: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    given = candidates.select("vec_id", "x", "dims", F.lit(False).alias("is_query"), one(blocks).alias("i"), every(query_blocks).alias("j"))
    asked = queries.select("vec_id", "x", "dims", F.lit(True).alias("is_query"), every(blocks).alias("i"), one(query_blocks).alias("j"))
    best = given.unionAll(asked).groupBy("dims", "i", "j").applyInArrow(lambda t: block_best(t, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, x``: components as floor(scale * component); null, empty and non-finite vectors are left out."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    return vectors.where(usable()).select(F.col("vec_id").cast("long"), x.alias("x"))
