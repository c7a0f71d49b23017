"""Vantage-point trees over bit fingerprints under Hamming distance; numpy, batched queries."""

from __future__ import annotations

import numpy as np

#: Points in a leaf, which are compared one by one.
LEAF = 48


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance along the last axis (uint64 words)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


class VantageTree:
    """Points split by their distance to a vantage point: within the median, or beyond it."""

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None):
        index = np.arange(len(points)) if index is None else index
        self.leaf, self.index = len(index) <= LEAF, index
        if self.leaf:
            return
        self.vantage = points[index[0]]
        d = distance(points[index], self.vantage)
        self.middle = int(np.median(d))
        near = d <= self.middle
        if near.all() or not near.any():  # ties: nothing to split by
            self.leaf = True
            return
        self.near, self.far = VantageTree(points, index[near]), VantageTree(points, index[~near])

    def within(self, points: np.ndarray, queries: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(query, point)`` index pairs at most ``radius`` apart, in blocks; ``queries`` are indices.

        A branch is left out for the queries whose ball cannot reach it, by the triangle inequality.
        """
        if not len(queries):
            return []
        if self.leaf:
            found = []
            step = max(1, 4_000_000 // max(1, len(self.index)))
            for at in range(0, len(queries), step):
                q = queries[at : at + step]
                hit = distance(points[q][:, None, :], points[self.index][None, :, :]) <= radius
                a, b = np.nonzero(hit)
                found.append((q[a], self.index[b]))
            return found
        d = distance(points[queries], self.vantage)
        return self.near.within(points, queries[d - radius <= self.middle], radius) + self.far.within(points, queries[d + radius > self.middle], radius)


def close_pairs(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs ``a < b`` of points at most ``radius`` apart."""
    blocks = VantageTree(points).within(points, np.arange(len(points)), radius)
    if not blocks:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = (np.concatenate(x) for x in zip(*blocks, strict=True))
    keep = a < b
    return a[keep], b[keep]
