"""Approximate nearest neighbours by 2-stable projections, a kd-tree and a chi-square test.

Vectors are projected to `PROJECTIONS` dimensions with Gaussian entries (the 2-stable law), the
same for all. If two vectors are at distance d, the square of their projected distance over d^2
follows a chi-square law with that many degrees of freedom. Projected rows of a shard are held in
a kd-tree. A query takes its leaves in order of their projected distance and verifies their rows
by the distance of the original vectors. Once all rows within projected distance D have been
verified, a row at true distance at most the k-th found, d_k, is still unseen with probability at
most 1 - F(D^2 / d_k^2); the query stops when F reaches `CONFIDENCE`. The k-th distances are
shared between shards by the two waves of `vectors.search`; a cell whose ball is farther than d_k
holds no nearer row and is not asked.

Nothing but that test ends a search: there is no cap on rows verified, and a confidence of 1 reads
all rows. Distances are exact, in double precision, on the original vectors.

Edge cases: vectors that are null, empty, all zero, or hold null or non-finite components take no
part, neither do rows with a null id; equal vectors are ranked by id (rows at distance 0 project
to distance 0 and are verified before the test can hold); a query with fewer than k candidates
gets all; an empty table gives an empty result; rows that repeat an id, and vectors of several
lengths: see `vectors`; extra columns are ignored.
"""

from __future__ import annotations

from math import exp

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlekit.llm import vectors

PROJECTIONS = 8
CONFIDENCE = 0.99
LEAF_ROWS = 64


def chi_square(x: float, degrees: int) -> float:
    """The distribution function, for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def chi_square_at(p: float, degrees: int) -> float:
    """The x at which the distribution function is p (infinite for p = 1)."""
    if p >= 1:
        return float("inf")
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def projection(dim: int, to: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, to))


def kd_leaves(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """The rows of each leaf of a kd-tree that splits the widest side in the middle."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf_rows:
            leaves.append(rows)
            continue
        part = points[rows]
        side = int((part.max(axis=0) - part.min(axis=0)).argmax())
        order = np.argpartition(part[:, side], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


def search_leaves(ids, rows, query_ids, queries, bounds, k, confidence=CONFIDENCE, projections=PROJECTIONS):
    """(query number, id, distance) of the best k rows of each query; the fourth item counts the
    rows that were verified."""
    n = len(queries)
    if not n or not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 0
    stop_at = chi_square_at(confidence, projections)
    onto = projection(rows.shape[1], projections)
    points, asked = rows @ onto, queries @ onto
    leaves = kd_leaves(points)
    low = np.array([points[x].min(axis=0) for x in leaves])
    high = np.array([points[x].max(axis=0) for x in leaves])
    top = np.full((n, k), np.inf)
    top_ids = np.full((n, k), np.iinfo(np.int64).max)
    least = np.full(n, np.inf) if bounds is None else np.where(np.isnan(bounds), np.inf, bounds)
    verified = 0
    for begin in range(0, n, 2048):
        block = np.arange(begin, min(n, begin + 2048))
        # squared projected distance of each query to each leaf's box
        gap = np.zeros((len(block), len(leaves)))
        for j in range(projections):
            x = asked[block, j][:, None]
            gap += np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0) ** 2
        order = np.argsort(gap, axis=1, kind="stable")
        active = np.arange(len(block))
        for turn in range(len(leaves)):
            chosen = order[active, turn]
            reach = gap[active, chosen] * (1 - 1e-9)
            # at distance 0 nothing is ruled out: equal rows are all verified
            limit = min(stop_at, 1e6) * np.minimum(least[block[active]], 1e150) ** 2
            going = (reach < limit) | (reach == 0) | np.isinf(stop_at)
            active, chosen = active[going], chosen[going]
            if not len(active):
                break
            by_leaf = np.argsort(chosen, kind="stable")
            starts = np.flatnonzero(np.diff(chosen[by_leaf], prepend=-1))
            for s, e in zip(starts, [*starts[1:], len(by_leaf)]):
                at = block[active[by_leaf[s:e]]]
                members = leaves[chosen[by_leaf[s]]]
                distance = np.empty((len(at), len(members)))
                for c in range(0, len(at), 256):
                    away = queries[at[c : c + 256]][:, None, :] - rows[members][None, :, :]
                    distance[c : c + 256] = np.sqrt((away * away).sum(axis=2))
                verified += distance.size
                distance[query_ids[at][:, None] == ids[members][None, :]] = np.inf
                better = distance.min(axis=1) <= least[at]
                at, distance = at[better], distance[better]
                if len(at):
                    all_d = np.concatenate([top[at], distance], axis=1)
                    all_i = np.concatenate([top_ids[at], np.broadcast_to(ids[members], distance.shape)], axis=1)
                    first = np.lexsort((all_i, all_d), axis=1)[:, :k]
                    top[at] = np.take_along_axis(all_d, first, axis=1)
                    top_ids[at] = np.take_along_axis(all_i, first, axis=1)
                    least[at] = np.minimum(least[at], top[at, k - 1])
    number, place = np.nonzero(top < np.inf)
    return number, top_ids[number, place], top[number, place], verified


def reaches(queries: np.ndarray, bounds: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Whether a ball may hold a row at a query's bound or nearer."""
    found = np.empty((len(queries), len(centres)), dtype=bool)
    sizes = np.sqrt((centres * centres).sum(axis=1)) + radii
    for i, q in enumerate(queries):
        away = centres - q
        least = np.sqrt((away * away).sum(axis=1)) - radii - 1e-9 * (np.sqrt((q * q).sum()) + sizes)
        found[i] = ~(least > bounds[i])  # no bound, or a distance that is no number: it may
    return found


def nearest(rows: DataFrame, every: int, k: int, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score (distance) over `rows` of (vec_id, embedding)."""

    def run(ids, vectors_, query_ids, queries, bounds):
        return search_leaves(ids, vectors_, query_ids, queries, bounds, k, confidence)[:3]

    base = vectors.usable(rows, "vec_id", "embedding", zero=False)
    return vectors.search(base, every, k, F.col("v"), "double", False, run, reaches)
