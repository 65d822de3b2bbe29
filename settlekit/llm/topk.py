"""Exact search of the largest inner products: a ball tree per shard, branch and bound.

A node of the tree covers some rows by a ball (centre c, radius r). No row in it has a larger
inner product with a query q than q.c + |q| r, so a node whose bound is below the query's k-th
best score holds nothing that it needs. All queries of a task descend together: at each node
those whose bound still reaches their k-th score go on, the child with the larger bound first,
and every leaf's scores (one matrix product) raise the k-th scores at once. Between shards the
k-th scores are shared by the two waves of `vectors.search`: a shard of the query's own cell sets
it, and only cells whose ball reaches it are asked, and start from it. Nothing is approximate: bounds carry a margin for rounding, and
a bound equal to the k-th score is followed, for ties go to the smaller id.

Scores are integers. Products are summed as doubles where all sums stay below 2^53 and are exact,
else as Python integers; a score beyond a long raises an error.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part,
neither do rows with a null id; all-zero vectors do; equal vectors are ranked by id; a query with
fewer than k candidates gets all; an empty table gives an empty result; rows that repeat an id,
and vectors of several lengths: see `vectors`; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit.llm import vectors

LEAF_ROWS = 128
SCALE = 256


class BallTree:
    """Nodes over the rows of a matrix; `order` lists the rows leaf by leaf."""

    def __init__(self, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.rows, self.leaf_rows, self.order = rows, leaf_rows, np.arange(len(rows))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        self._build(0, len(rows))

    def _build(self, start: int, end: int) -> int:
        part = self.rows[self.order[start:end]]
        centre = part.mean(axis=0)
        away = part - centre
        distance = np.sqrt((away * away).sum(axis=1))
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(distance.max()) * (1 + 1e-9) + 1e-9)
        self.span.append((start, end))
        self.children.append(None)
        if end - start > self.leaf_rows:
            # split in the middle along the line through two far rows; equal rows split too
            a = part[int(distance.argmax())]
            b = part[int(((part - a) ** 2).sum(axis=1).argmax())]
            middle = (start + end) // 2
            halves = np.argpartition(part @ (b - a), middle - start)
            self.order[start:end] = self.order[start:end][halves]
            self.children[node] = (self._build(start, middle), self._build(middle, end))
        return node


def search_tree(tree: BallTree, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray | None, k: int):
    """The best k rows of each query, as (query number, id, score); visited leaves are counted
    in the fourth item."""
    n = len(queries)
    top = np.full((n, k), -np.inf)
    top_ids = np.full((n, k), np.iinfo(np.int64).max)
    least = np.full(n, -np.inf) if bounds is None else np.where(np.isnan(bounds), -np.inf, bounds)
    norms = np.sqrt((queries * queries).sum(axis=1))
    centres, radii = np.array(tree.centre), np.array(tree.radius)
    visited = 0

    def limit(node: int, at: np.ndarray) -> np.ndarray:
        upper = queries[at] @ centres[node] + norms[at] * radii[node]
        return upper + 1e-9 * np.abs(upper) + 1e-6

    def leaf(node: int, at: np.ndarray) -> None:
        start, end = tree.span[node]
        rows = tree.order[start:end]
        scores = queries[at] @ tree.rows[rows].T
        scores[query_ids[at][:, None] == ids[rows][None, :]] = -np.inf
        better = scores.max(axis=1) >= least[at]
        at, scores = at[better], scores[better]
        if not len(at):
            return
        all_scores = np.concatenate([top[at], scores], axis=1)
        all_ids = np.concatenate([top_ids[at], np.broadcast_to(ids[rows], scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        top[at] = np.take_along_axis(all_scores, order, axis=1)
        top_ids[at] = np.take_along_axis(all_ids, order, axis=1)
        least[at] = np.maximum(least[at], top[at, k - 1])

    def descend(node: int, at: np.ndarray) -> None:
        nonlocal visited
        at = at[limit(node, at) >= least[at]]
        if not len(at):
            return
        children = tree.children[node]
        if children is None:
            visited += len(at)
            leaf(node, at)
            return
        left, right = children
        first = limit(left, at) >= limit(right, at)
        for some, order in ((at[first], (left, right)), (at[~first], (right, left))):
            for child in order:
                descend(child, some)

    if n and len(ids):
        descend(0, np.arange(n))
    number, place = np.nonzero(top > -np.inf)
    return number, top_ids[number, place], top[number, place], visited


def reaches(queries: np.ndarray, bounds: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Whether a ball may hold a row whose inner product is a query's bound or more."""
    norms = np.sqrt((queries * queries).sum(axis=1))[:, None]
    size = norms * (np.sqrt((centres * centres).sum(axis=1)) + radii)
    upper = queries @ centres.T + norms * radii + 1e-9 * size + 1e-6
    return ~(upper < bounds[:, None])  # no bound, or a product that is no number: it may


def _exact(ids, rows, query_ids, queries, bounds, k):
    """Scores as Python integers, for components too large for doubles."""
    out: list[tuple[int, int, int]] = []
    whole = rows.astype(object)
    for i, (name, q) in enumerate(zip(query_ids, queries.astype(object))):
        scores = [(int(s), int(j)) for j, s in zip(ids, whole @ q) if j != name]
        out.extend((i, j, s) for s, j in sorted(scores, key=lambda x: (-x[0], x[1]))[:k])
    if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in out):
        raise OverflowError("an inner product does not fit a long")
    number, found, scores = (np.array(c, dtype=np.int64) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3
    return number, found, scores


def inner_products(rows: DataFrame, every: int, k: int, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score over `rows` of (vec_id, embedding)."""

    def run(ids, vectors_, query_ids, queries, bounds):
        most = max(float(np.abs(vectors_).max(initial=0)), float(np.abs(queries).max(initial=0)))
        if most * most * vectors_.shape[1] >= 2.0**53:
            return _exact(ids, vectors_, query_ids, queries, bounds, k)
        tree = BallTree(vectors_.astype(float))
        number, found, scores, _ = search_tree(tree, ids, query_ids, queries.astype(float), bounds, k)
        return number, found, scores.astype(np.int64)

    base = vectors.usable(rows, "vec_id", "embedding", zero=True)
    prepare = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return vectors.search(base, every, k, prepare, "long", True, run, reaches)
