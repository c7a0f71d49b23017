"""Exact order statistics of the columns of a table that no single process holds.

Doubles are mapped to integers of the same order, whose bytes are decided from the first to the last:
a pass counts, for every prefix that a wanted rank lies in, the next byte over all rows. Eight passes
give the values; what a pass sends is bounded by ranks and columns and does not grow with the rows.
"""

from __future__ import annotations

import numpy as np

PASSES = 8


def keys(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles ``x``."""
    bits = (np.nan_to_num(x) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def values(found: np.ndarray) -> np.ndarray:
    """The doubles of ``keys``."""
    return np.where(found >> np.uint64(63), found & np.uint64((1 << 63) - 1), ~found).view(np.float64)


def count(x: np.ndarray, prefixes: list[np.ndarray], done: int) -> np.ndarray:
    """Counts of the byte after ``done`` bytes, for all columns of ``x`` and each of their sorted prefixes."""
    shift = np.uint64(56 - 8 * done)
    parts = []
    for k, known in enumerate(prefixes):
        key = keys(np.ascontiguousarray(x[:, k])) >> shift
        byte = (key & np.uint64(255)).astype(np.int64)
        before = key >> np.uint64(8)
        at = np.minimum(np.searchsorted(known, before), len(known) - 1)
        here = known[at] == before
        parts.append(np.bincount(at[here] * 256 + byte[here], minlength=256 * len(known)))
    return np.concatenate(parts)


class Search:
    """The values at ``ranks`` (from 0) of each of ``columns`` columns, pass by pass."""

    def __init__(self, columns: int, ranks: np.ndarray) -> None:
        self.prefix = np.zeros((columns, len(ranks)), dtype=np.uint64)
        self.left = np.tile(np.asarray(ranks, dtype=np.int64), (columns, 1))  # rank among the rows of the prefix

    def prefixes(self) -> list[np.ndarray]:
        return [np.unique(p) for p in self.prefix]

    def narrow(self, counts: np.ndarray) -> None:
        """Take the counts of all rows for ``prefixes()``."""
        at = 0
        for k, known in enumerate(self.prefixes()):
            table = counts[at : at + 256 * len(known)].reshape(-1, 256)
            at += 256 * len(known)
            ends = np.cumsum(table, axis=1)
            for r, p in enumerate(self.prefix[k]):
                row = int(np.searchsorted(known, p))
                byte = int(np.searchsorted(ends[row], self.left[k, r], side="right"))
                self.left[k, r] -= ends[row, byte] - table[row, byte]
                self.prefix[k, r] = (p << np.uint64(8)) | np.uint64(byte)


def quantile_ranks(rows: int, shares: np.ndarray) -> np.ndarray:
    """The ranks whose values ``quantiles`` needs: those below and above each share of the rows."""
    below = np.floor((rows - 1) * shares).astype(np.int64)
    return np.concatenate([below, np.minimum(below + 1, rows - 1)])


def quantiles(found: np.ndarray, rows: int, shares: np.ndarray) -> np.ndarray:
    """Of the values at ``quantile_ranks``, the quantiles that ``numpy.quantile`` gives for all rows."""
    place = (rows - 1) * shares
    t = place - np.floor(place)
    a, b = found[..., : len(shares)], found[..., len(shares) :]
    return np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t))
