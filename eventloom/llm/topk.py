"""Exact top-k inner products by no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import finite
from eventloom.llm.shards import search

#: Distinct vectors whose lists one task reads, and queries that read them together.
LIST_BLOCK, QUERY_BLOCK = 16_384, 256
#: Rows left, as a multiple of k, whose scores are resolved.
FEW = 4
#: Shares of the lists after which bounds are compared.
LOOKS = (0.25, 0.5, 0.75, 0.88, 0.94, 0.97)


class SortedLists:
    """For each dimension a list of (row, value) by value; nothing is looked up by row.

    A query reads a list from its high end if its weight for the dimension is positive, else
    from its low end. All queries of a block read on together, so that an entry is read once
    for all that come from its end.
    """

    def __init__(self, vectors: np.ndarray):
        self.n, self.dim = vectors.shape
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        #: entries read by the last queries answered, of as many as the lists have for them
        self.read = 0

    def top(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows, in any order, that can be among the k best, with scores."""
        out = []
        for at in range(0, len(queries), QUERY_BLOCK):
            out += Reading(self, queries[at : at + QUERY_BLOCK], k).finish()
        return out


class Reading:
    """Queries that read the lists of a shard, and what they know so far.

    ``known`` holds the values read, (row, dimension), from the high and from the low ends of
    the lists, and where nothing was read the value at the far end, so that products with the
    weights are lower bounds of scores. With the value at the reading point in its place they
    are upper bounds. A row whose upper bound is under the k-th lower bound is out for good.
    When few rows are left, all others cannot qualify: then a list is read on only until it has
    shown those few, and the sums of what was read are their scores. Ties with the k-th are all
    kept.
    """

    def __init__(self, lists: SortedLists, queries: np.ndarray, k: int):
        self.lists, self.queries, self.k = lists, queries, min(k, lists.n)
        shape = (lists.n, lists.dim)
        ends = lists.values[[0, -1]]
        self.known = [np.broadcast_to(end, shape).copy() for end in ends]
        self.met = [np.zeros(shape, dtype=bool) for _ in ends]
        self.alive = np.ones((len(queries), lists.n), dtype=bool)
        self.depth = 0
        # whole numbers are exact in the smaller type up to 2^24, in the larger up to 2^53
        size = np.abs(ends.astype(float)).max(axis=0)
        most = np.abs(queries).astype(float) @ size
        largest = max(most.max(initial=0), size.max(initial=0), np.abs(queries).max(initial=0))
        self.kind = np.float32 if largest < 2**22 else np.float64
        self.slack = np.where(largest < 2**51, 0, most * 1e-10)
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.open = np.arange(len(queries))
        lists.read = 0

    def finish(self) -> list[tuple[np.ndarray, np.ndarray]]:
        lists = self.lists
        for depth in sorted({max(self.k, int(share * lists.n)) for share in LOOKS}):
            if len(self.open) and depth < lists.n:
                self._read_to(depth)
                self._drop_outsiders()
        if len(self.open):
            self._read_to(lists.n)
            for query, left in zip(self.open, self.alive):
                rows = np.flatnonzero(left)
                self.found[query] = self._best(rows, self._sums(query, rows))
        return [self.found[i] for i in range(len(self.queries))]

    def _best(self, rows: np.ndarray, scores: np.ndarray):
        if len(rows) > self.k:
            keep = scores >= np.partition(scores, len(rows) - self.k)[len(rows) - self.k]
            rows, scores = rows[keep], scores[keep]
        return rows, scores

    def _read_to(self, depth: int) -> None:
        """Read all lists on, from both ends."""
        lists, n = self.lists, self.lists.n
        for side, part in ((0, slice(n - depth, n - self.depth)), (1, slice(self.depth, depth))):
            np.put_along_axis(self.known[side], lists.order[part], lists.values[part], axis=0)
            np.put_along_axis(self.met[side], lists.order[part], True, axis=0)
        lists.read += lists.dim * (depth - self.depth) * len(self.open)
        self.depth = depth

    def _drop_outsiders(self) -> None:
        lists, n, depth, kind = self.lists, self.lists.n, self.depth, self.kind
        queries = self.queries[self.open]
        weights = [np.maximum(queries, 0), np.minimum(queries, 0)]
        gaps = [lists.values[n - depth] - lists.values[0], lists.values[depth - 1] - lists.values[-1]]
        lower = sum(w.astype(kind) @ known.astype(kind).T for w, known in zip(weights, self.known))
        upper = lower.copy()
        for w, gap, met in zip(weights, gaps, self.met):
            upper += (w.astype(kind) * gap.astype(kind)) @ (~met).astype(kind).T
        floor = np.partition(lower, n - self.k, axis=1)[:, n - self.k] - self.slack[self.open]
        self.alive &= upper >= floor[:, None]
        done = self.alive.sum(axis=1) <= FEW * self.k
        for query, left in zip(self.open[done], self.alive[done]):
            rows = np.flatnonzero(left)
            self.found[query] = self._best(rows, self._resolve(query, rows))
        self.open, self.alive = self.open[~done], self.alive[~done]

    def _sums(self, query: int, rows: np.ndarray) -> np.ndarray:
        """What the entries read say of the scores of rows."""
        weights = self.queries[query]
        signed = (np.maximum(weights, 0), np.minimum(weights, 0))
        return sum(
            np.where(met[rows], known[rows], 0) @ w for w, known, met in zip(signed, self.known, self.met)
        )

    def _resolve(self, query: int, rows: np.ndarray) -> np.ndarray:
        """Final scores of the rows left: each list is read on until all of them were met in it."""
        lists, n, depth = self.lists, self.lists.n, self.depth
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        weights, sums = self.queries[query], self._sums(query, rows)
        high = np.arange(n - depth - 1, -1, -1), np.flatnonzero(weights > 0)
        low = np.arange(depth, n), np.flatnonzero(weights < 0)
        for ahead, dims in (high, low):
            met = place[lists.order[np.ix_(ahead, dims)]]
            at, column = np.nonzero(met >= 0)
            products = lists.values[ahead[at], dims[column]] * weights[dims[column]]
            np.add.at(sums, met[at, column], products)
            last = np.zeros(len(dims), dtype=np.int64)
            np.maximum.at(last, column, at + 1)
            lists.read += int(last.sum())
        return sums


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest integer inner products.

    ``vectors`` has vec_id and v, an array of longs; queries are the rows that ``is_query``
    marks, candidates all rows with another vec_id. Ties go to the smaller vec_id. In each
    shard queries read sorted lists, one for each dimension, see ``Reading``; see
    ``shards.search`` for copies, hot vectors and memory.

    Only vectors of equal length are compared. Rows without vec_id or vector take no part;
    equal rows count once, and one vec_id must not name different vectors; a query with fewer
    candidates gets them all, with none no row; no vectors give no rows. Scores must fit a
    long. Other columns are ignored.
    """

    def index(matrix: np.ndarray):
        lists = SortedLists(matrix)
        return lambda queries: lists.top(queries, k + 1)

    return search(vectors, is_query, k, LIST_BLOCK, index, "long", highest=True)


def quantized(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); v is null if any is null or not finite."""
    whole = F.transform(column, lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return vectors.select("vec_id", F.when(finite(column), whole).alias("v"))
