"""Approximate nearest neighbours in few random projections, verified in the order of projected distance.

Projections with normal coefficients are 2-stable: the squared projected distance of two points is their squared
distance times a chi-square variable of ``DIMENSIONS`` degrees. So once all points that are left lie
beyond a projected distance, the chance that one of them is nearer than the worst of the ``k`` found is known, and the
search stops when it is small enough.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passel.llm.vectors import one_row_each, search_parts, usable

DIMENSIONS = 8
# The chance that a true neighbour lies within the projected distance at which the search stops.
CONFIDENCE = 0.95
LEAF = 256
SEED = 11
# Inner products by matrix and term by term differ by less than this share of the lengths.
ROUNDING = 1e-12


def chi_square(x: float, degrees: int) -> float:
    """The distribution function of chi-square for an even number of degrees."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


class ProjectedTree:
    """A kd-tree over the projections of one part."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, dimensions: int = DIMENSIONS, leaf: int = LEAF):
        squares = (vectors * vectors).sum(axis=1)
        self.square = float(squares.max())
        # One component more makes all vectors as long as the longest, so the nearest has the largest inner product.
        extra = np.sqrt(np.maximum(self.square - squares, 0.0))
        self.axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, dimensions))
        points = vectors @ self.axes[:-1] + extra[:, None] * self.axes[-1]
        self.low, self.high, self.below = [], [], []
        self.order = np.arange(len(points))
        self._add(points, 0, len(points), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        # Rows of a leaf lie side by side.
        self.vectors, self.ids = np.ascontiguousarray(vectors[self.order]), ids[self.order]

    def _add(self, points: np.ndarray, start: int, end: int, leaf: int) -> int:
        """The node of ``order[start:end]``: a box, and two nodes or a run of rows."""
        own = points[self.order[start:end]]
        node = len(self.below)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.below.append((start, end, -1, -1))
        if end - start > leaf:
            middle = (end - start) // 2
            axis = int(np.argmax(self.high[node] - self.low[node]))
            self.order[start:end] = self.order[start:end][np.argpartition(own[:, axis], middle)]
            left = self._add(points, start, start + middle, leaf)
            right = self._add(points, start + middle, end, leaf)
            self.below[node] = (start, end, left, right)
        return node

    def _boxes(self, point: np.ndarray, nodes: list[int]) -> list[float]:
        """Squared distances from a projected query to boxes."""
        away = np.maximum(np.maximum(self.low[nodes] - point, point - self.high[nodes]), 0.0)
        return (away * away).sum(axis=1).tolist()

    def search(self, query: np.ndarray, query_id: int, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of up to ``k`` near vectors but the query's own, best first, ties to smaller ids."""
        point = query @ self.axes[:-1]
        length = float(query @ query)
        margin = ROUNDING * (length * self.square) ** 0.5
        rows, scores, worst = np.empty(0, np.int64), np.empty(0), math.inf
        heap = [(self._boxes(point, [0])[0], 0)]
        while heap:
            projected, node = heapq.heappop(heap)
            # All that is left is projected at least this far; equal vectors must not end the search by rounding.
            if projected > quantile * (worst + margin):
                break
            start, end, left, right = self.below[node]
            if left >= 0:
                for below, distance in zip((left, right), self._boxes(point, [left, right])):
                    heapq.heappush(heap, (distance, below))
                continue
            new = np.arange(start, end)[self.ids[start:end] != query_id]
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.vectors[new] @ query])
            if len(rows) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = scores >= least - margin
                rows, scores = rows[near], scores[near]
            if len(rows) >= k:
                worst = max(length + self.square - 2.0 * float(scores.min()), 0.0)
        exact = np.cumsum(self.vectors[rows] * query, axis=1)[:, -1] if len(rows) else scores
        top = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows[top]], exact[top]


def near_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    confidence: float = CONFIDENCE,
    **options,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the inner product, of ``k`` near vectors of each query.

    A true neighbour is missed with a chance of at most 1 - ``confidence``; the scores are exact. A query is a row of
    ``queries`` by the same columns; candidates are all rows of ``vectors`` that do not have its id. Null and zero
    vectors, those with a null or non-finite component, and rows without an id take no part; shorter vectors count as
    filled up with zeros. A repeated row is a candidate of its own; of several query vectors under one id the
    smallest counts. With fewer candidates than ``k`` all are given.
    """
    quantile = chi_square_quantile(confidence, DIMENSIONS)

    def nonzero(df: DataFrame) -> DataFrame:
        return usable(df, id_col, vector_col).where(F.exists("vector", lambda x: x != 0))

    def find(ids: np.ndarray, own: np.ndarray, query_ids: np.ndarray, asked: np.ndarray) -> tuple:
        tree = ProjectedTree(own, ids)
        found = [(q, *tree.search(vector, q, k, quantile)) for q, vector in zip(query_ids.tolist(), asked)]
        counts = [len(f[1]) for f in found]
        return np.repeat(query_ids, counts), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])

    return search_parts(nonzero(vectors), one_row_each(nonzero(queries)), find, "double", k, **options)
