"""Exact top-k by inner product of quantised vectors, with M-trees searched best first.

With a further component that gives all vectors the same length, the largest inner product belongs to the
smallest Euclidean distance, so that a metric tree can be used. Distances only decide what is read; scores are
exact integers.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passel.llm.vectors import one_row_each, search_parts, usable

LEVELS = 256
# Entries of a page.
PAGE = 256
# Components up to this size have exact sums of products in floating point, for some hundred of them.
FLOAT_SAFE = 1 << 22
# Distances come from integers below 2**53 by one root; this share of the largest one covers their rounding.
SLACK = 1e-9


@dataclass
class Page:
    """A node: objects or further pages, each with its distance to the pivot of this page."""

    pivot: int
    radius: float
    rows: np.ndarray
    to_parent: np.ndarray
    children: list["Page"] | None = None
    radii: np.ndarray | None = None


class MTree:
    """Vectors of one part in pages that hold a pivot, a covering radius and the distances of their entries to it."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, page: int = PAGE):
        self.page, self.computed = page, 0
        self.random = np.random.default_rng(0)
        # Whole numbers either way; floating point multiplies faster.
        safe = np.abs(vectors).max(initial=0) < FLOAT_SAFE and vectors.shape[1] <= 256
        self.vectors = vectors.astype(np.float64) if safe else vectors
        squares = (vectors * vectors).sum(axis=1)
        self.square = int(squares.max())
        self.extra = np.sqrt((self.square - squares).astype(np.float64))
        self.slack = SLACK * (1 + 2 * self.square**0.5)
        clusters = self._clusters(np.arange(len(ids)))
        # The rows of a leaf lie side by side.
        order = np.concatenate(clusters)
        self.vectors, self.extra, self.ids = self.vectors[order], self.extra[order], ids[order]
        ends = np.cumsum([len(c) for c in clusters]).tolist()
        pages = [self._leaf(a, b) for a, b in zip([0, *ends], ends)]
        while len(pages) > 1:
            pages = self._above(pages)
        self.root = pages[0]

    def _between(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        """Distances between vectors of the tree."""
        inner = self.vectors[rows] @ self.vectors[pivot] + self.extra[rows] * self.extra[pivot]
        return np.sqrt(np.maximum(2.0 * (self.square - inner), 0.0))

    def _clusters(self, rows: np.ndarray) -> list[np.ndarray]:
        """``rows`` by nearest of some pivots, cut until every cluster fits into a page."""
        todo, out = [rows], []
        while todo:
            rows = todo.pop()
            if len(rows) <= self.page:
                out.append(rows)
                continue
            pivots = self.random.choice(rows, min(self.page, -(-2 * len(rows) // self.page)), replace=False)
            nearest = np.argmin(np.stack([self._between(rows, p) for p in pivots]), axis=0)
            parts = [part for i in range(len(pivots)) if len(part := rows[nearest == i])]
            if len(parts) == 1:
                # Equal vectors can't be told apart by distance.
                parts = np.array_split(rows, -(-len(rows) // self.page))
            todo += parts
        return out

    def _leaf(self, start: int, end: int) -> Page:
        rows = np.arange(start, end)
        to_pivot = self._between(rows, start)
        return Page(start, float(to_pivot.max()), rows, to_pivot)

    def _above(self, pages: list[Page]) -> list[Page]:
        by_pivot: dict[int, list[Page]] = {}
        for page in pages:
            by_pivot.setdefault(page.pivot, []).append(page)
        out = []
        for own in self._clusters(np.array([p.pivot for p in pages])):
            children = [by_pivot[p].pop() for p in own.tolist()]
            to_pivot, radii = self._between(own, own[0]), np.array([c.radius for c in children])
            out.append(Page(own[0], float((to_pivot + radii).max()), own, to_pivot, children, radii))
        return out

    def search(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) but for the query's own id, best first, ties to smaller ids."""
        vectors, slack, square = self.vectors, self.slack, float(self.square + int(query @ query))
        query = query.astype(vectors.dtype) if np.abs(query).max(initial=0) < FLOAT_SAFE else query
        best: list[tuple[int, int]] = []
        bound = np.inf

        def distances(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            self.computed += len(rows)
            scores = vectors[rows] @ query
            return scores, np.sqrt(np.maximum(square - 2.0 * scores, 0.0))

        _, (to_root,) = distances(np.array([self.root.pivot]))
        heap, number = [(0.0, 0, float(to_root), self.root)], 0
        while heap:
            least, _, to_pivot, page = heapq.heappop(heap)
            if least > bound + slack:
                break
            # No entry is nearer than the difference of the two distances to the pivot, less its radius.
            floor = np.abs(to_pivot - page.to_parent)
            if page.children is None:
                near = page.rows[floor <= bound + slack]
                if not len(near):
                    continue
                # A whole page is read as it lies.
                whole = len(near) == len(page.rows)
                self.computed += len(near)
                scores = vectors[near[0] : near[-1] + 1] @ query if whole else vectors[near] @ query
                good = self.ids[near] != query_id
                if len(best) == k:
                    good &= scores >= best[-1][0]
                near, scores = near[good], scores[good]
                if len(near) > k:
                    top = np.lexsort((self.ids[near], -scores))[:k]
                    near, scores = near[top], scores[top]
                if not len(near):
                    continue
                best += zip(map(int, scores.tolist()), self.ids[near].tolist())
                best.sort(key=lambda b: (-b[0], b[1]))
                del best[k:]
                if len(best) == k:
                    bound = max(square - 2.0 * best[-1][0], 0.0) ** 0.5
                continue
            near = np.flatnonzero(floor - page.radii <= bound + slack)
            _, to_child = distances(page.rows[near])
            for i, d in zip(near.tolist(), to_child.tolist()):
                below = max(least, d - page.children[i].radius)
                if below <= bound + slack:
                    number += 1
                    heapq.heappush(heap, (below, number, d, page.children[i]))
        return best


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", **options
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the ``k`` vectors of the largest integer inner product.

    A component x counts as floor(256 * x). A query is a row of ``queries`` by the same columns; candidates are all
    rows of ``vectors`` that do not have its id. Null vectors, those with a null or non-finite component, and rows
    without an id take no part; shorter vectors count as filled up with zeros. A repeated row is a candidate of its
    own; of several query vectors under one id the smallest counts. With fewer candidates than ``k`` all are given.
    Scores are 64-bit integers.
    """

    def whole(df: DataFrame) -> DataFrame:
        scaled = F.transform("vector", lambda x: F.floor(x * LEVELS).cast("long"))
        return usable(df, id_col, vector_col).select("vec_id", scaled.alias("vector"))

    def find(ids: np.ndarray, own: np.ndarray, query_ids: np.ndarray, asked: np.ndarray) -> tuple:
        tree = MTree(own, ids)
        found = [(q, i, s) for q, vector in zip(query_ids.tolist(), asked) for s, i in tree.search(vector, q, k)]
        return tuple(np.array(c, np.int64) for c in zip(*found)) or (np.empty(0, np.int64),) * 3

    return search_parts(whole(vectors), one_row_each(whole(queries)), find, "long", k, **options)
