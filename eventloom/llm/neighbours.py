"""Nearest neighbours by forests of random-projection trees and one queue over all of them."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import finite
from eventloom.llm.shards import search

#: Distinct vectors of one forest, on average; a task holds one forest at a time.
SHARD = 32_768
#: Trees of a forest, and vectors of a leaf at most.
TREES, LEAF = 16, 32
#: A search looks at this share of a shard's vectors, or at so many, unless it can stop before.
SHARE, LEAST = 0.4, 8_192
#: Vectors gathered from leaves before their distances are taken.
STEP = 1_024
SEED = 13


class Tree:
    """A balanced tree: each level halves its nodes along one direction; directions are orthonormal.

    What a point must cross to reach a node adds up level by level, so the sum of the squared
    gaps is never more than the squared distance to any vector below the node.
    """

    def __init__(self, vectors: np.ndarray, leaf: int, rng: np.random.Generator):
        n, dim = vectors.shape
        self.depth = min(dim, max(0, math.ceil(math.log2(max(1, n) / leaf))))
        self.directions = np.linalg.qr(rng.normal(size=(dim, self.depth)))[0]
        along = vectors @ self.directions
        self.order, self.bounds = np.arange(n), np.array([0, n])
        #: for each level the largest value of each left half and the least of each right half
        self.low, self.high = [], []
        for level in range(self.depth):
            node = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
            place = np.lexsort((along[self.order, level], node))
            self.order = self.order[place]
            value = along[self.order, level]
            middle = (self.bounds[:-1] + self.bounds[1:]) // 2
            self.low.append(value[np.maximum(middle - 1, self.bounds[:-1])].tolist())
            self.high.append(value[np.minimum(middle, n - 1)].tolist())
            halves = np.empty(2 * len(self.bounds) - 1, dtype=np.int64)
            halves[0::2], halves[1::2] = self.bounds, middle
            self.bounds = halves

    def members(self, leaf: int) -> np.ndarray:
        return self.order[self.bounds[leaf] : self.bounds[leaf + 1]]


class Forest:
    """Trees over the same vectors, searched together."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = vectors
        self.trees = [Tree(vectors, leaf, rng) for _ in range(trees)]

    def leaves(self, query: np.ndarray):
        """(squared gap, rows) of the leaves of all trees, the nearest first."""
        along = [(query @ tree.directions).tolist() for tree in self.trees]
        queue = [(0.0, t, 0, 0) for t in range(len(self.trees))]  # gap, tree, level, node
        while queue:
            gap, t, level, node = heapq.heappop(queue)
            tree = self.trees[t]
            if level == tree.depth:
                yield gap, tree.members(node)
                continue
            at = along[t][level]
            left, right = at - tree.low[level][node], tree.high[level][node] - at
            heapq.heappush(queue, (gap + left * left if left > 0 else gap, t, level + 1, 2 * node))
            heapq.heappush(
                queue, (gap + right * right if right > 0 else gap, t, level + 1, 2 * node + 1)
            )

    def nearest(self, query: np.ndarray, k: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances): the k nearest found, and what ties with the last, in any order.

        Leaves are taken from the queue until no vector outside can be nearer than the k-th
        found, which makes the answer exact, or until ``budget`` vectors were looked at.
        """
        seen = np.zeros(len(self.vectors), dtype=bool)
        rows, squares = np.zeros(0, dtype=np.int64), np.zeros(0)
        waiting, gathered, looked, kth = [], 0, 0, math.inf
        for gap, members in self.leaves(query):
            if gap > kth * (1 + 1e-9) or looked >= budget:
                break
            waiting.append(members)
            gathered += len(members)
            if gathered >= STEP:
                rows, squares, new = self._look(query, waiting, seen, rows, squares, k)
                waiting, gathered, looked = [], 0, looked + new
                kth = squares.max() if len(squares) >= k else math.inf
        if waiting:
            rows, squares, _ = self._look(query, waiting, seen, rows, squares, k)
        return rows, np.sqrt(squares)

    def _look(self, query, waiting, seen, rows, squares, k):
        fresh = np.unique(np.concatenate(waiting))
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        apart = self.vectors[fresh] - query
        rows = np.concatenate([rows, fresh])
        squares = np.concatenate([squares, np.einsum("ij,ij->i", apart, apart)])
        if len(rows) > k:
            keep = squares <= np.partition(squares, k - 1)[k - 1]
            rows, squares = rows[keep], squares[keep]
        return rows, squares, len(fresh)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    trees: int = TREES,
    leaf: int = LEAF,
    share: float = SHARE,
    least: int = LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest by Euclidean distance.

    ``vectors`` has vec_id and v, an array of doubles; queries are the rows that ``is_query``
    marks, candidates all rows with another vec_id. Distances are taken on the vectors as
    given; ties go to the smaller vec_id.

    Each shard of ``SHARD`` distinct vectors has a forest of ``trees`` trees with leaves of
    ``leaf`` vectors, over all its vectors. There a query takes leaves of all trees from one
    queue, the nearest first, until nothing outside can be nearer or a ``share`` of the shard
    (``least`` at the least) was looked at. That bound makes the search approximate. See
    ``shards.search`` for copies, hot vectors and memory.

    Only vectors of equal length are compared. Rows without vec_id, and vectors that are null,
    empty or zero, take no part; equal rows count once, and one vec_id must not name different
    vectors. A query with fewer candidates gets them all, with none no row; no vectors give no
    rows. Other columns are ignored.
    """

    def index(matrix: np.ndarray):
        forest, budget = Forest(matrix, trees, leaf), max(least, math.ceil(share * len(matrix)))
        return lambda queries: [forest.nearest(q, k + 1, budget) for q in queries]

    usable = vectors.where(F.exists("v", lambda x: x != 0))
    return search(usable, is_query, k, SHARD, index, "double", highest=False)


def usable_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors as doubles; v is null if any component is null or not finite."""
    whole = F.transform(column, lambda x: x.cast("double"))
    return vectors.select("vec_id", F.when(finite(column), whole).alias("v"))
