"""Gradient-boosted trees grown from histograms that are summed over any number of rows, and Platt
calibration; plain numpy.

The rows lie in blocks: one byte per feature (its bin) and a label. A tree is grown level by level from the
sums of the gradients per node, feature and bin. They are sums of integers, so they are the same
however the rows are dealt over blocks and tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass, field

import numpy as np

BINS = 32
#: The shares of the rows at whose quantiles bins end.
SHARES = np.linspace(0, 1, BINS + 1)[1:-1]
#: Gradients are counted in units of 1 / UNIT: a block's sums are exact in doubles, those of all blocks in 64 bits.
UNIT = 1 << 30
#: Units of a histogram's three parts.
UNITS = np.array([UNIT, UNIT, 1])

#: Bins by feature and row, and labels.
Block = tuple[np.ndarray, np.ndarray]


@dataclass
class Level:
    """What the rows are asked: the sums for some nodes of the tree that is being grown."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    feature: np.ndarray
    cut: np.ndarray
    nodes: list[int]

    def shape(self, features: int) -> tuple[int, ...]:
        return 3, features, len(self.nodes), BINS


def leaves(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node of a heap-shaped tree that every row ends in."""

    def at(n: int):
        if n >= len(feature) or feature[n] < 0:
            return np.int8(n)
        left, right = at(2 * n + 1), at(2 * n + 2)
        return left ^ ((left ^ right) & -(bins[feature[n]] > cut[n]).view(np.int8))  # a where of bytes, several times as fast

    return np.broadcast_to(at(0), bins.shape[1:])


def scores(base: float, trees: list, bins: np.ndarray) -> np.ndarray:
    score = np.full(bins.shape[1], base)
    for feature, cut, value in trees:
        score += np.take(value, leaves(feature, cut, bins), mode="clip")
    return score


def histogram(block: Block, asked: Level) -> np.ndarray:
    """Sums of gradients, second derivatives and rows of a block, by feature, node and bin."""
    bins, y = block
    out = np.zeros(asked.shape(len(bins)), dtype=np.int64)
    number = np.full(len(asked.feature), -1)
    number[asked.nodes] = np.arange(len(asked.nodes))
    place = np.take(number, leaves(asked.feature, asked.cut, bins))
    here = np.flatnonzero(place >= 0)
    if len(here) < len(place):
        place, y, bins = place[here], y[here], np.take(bins, here, axis=1)
    p = 1 / (1 + np.exp(-scores(asked.base, asked.trees, bins)))
    g, h = np.rint((y - p) * UNIT), np.rint(p * (1 - p) * UNIT)
    place *= BINS
    size = BINS * len(asked.nodes)
    for k, b in enumerate(bins):
        at = place + b
        for part, weights in enumerate((g, h, None)):
            out[part, k] = np.bincount(at, weights, size).reshape(-1, BINS)
    return out


def grow_together(growths: list[Generator], sums: Callable[[list[Level | None]], list]) -> None:
    """Grow several models at once: each pass over the rows (``sums``) answers what all of them ask."""
    asked = [next(g, None) for g in growths]
    while any(a is not None for a in asked):
        got = sums(asked)
        for k, growth in enumerate(growths):
            if asked[k] is not None:
                try:
                    asked[k] = growth.send(got[k])
                except StopIteration:
                    asked[k] = None


@dataclass
class Trees:
    """Boosted trees with logistic loss over binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    depth: int = 3

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins by feature and row."""
        x = np.nan_to_num(x)
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, **parameters) -> Trees:
        """Fit to labels 0 and 1. Constant features and single-class labels are fine."""
        x = np.nan_to_num(x)
        self.edges = [np.unique(np.quantile(x[:, k], SHARES)) for k in range(x.shape[1])]
        block = self.binned(x), y
        grow_together([self.growth(len(y), y.sum(), **parameters)], lambda asked: [histogram(block, asked[0])])
        return self

    def growth(self, rows: int, positive: int, rounds: int = 60, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0) -> Generator[Level, np.ndarray, None]:
        """Grow the trees from the sums over all rows: yields a ``Level``, takes its histogram."""
        share = float(np.clip(positive / rows if rows else 0.5, 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        size = (1 << (self.depth + 1)) - 1
        for _ in range(rounds):
            feature, cut, total = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.uint8), np.zeros((3, size))
            known: dict[int, np.ndarray] = {}
            for level in range(self.depth):
                first = (1 << level) - 1
                # of two nodes the smaller is asked for, the other is what it leaves of their parent
                split = [n for n in range(first // 2, first) if feature[n] >= 0 and total[2, [2 * n + 1, 2 * n + 2]].max() >= 2 * least]
                nodes = [int(2 * n + 1 + (total[2, 2 * n + 2] < total[2, 2 * n + 1])) for n in split] if level else [0]
                if not nodes:
                    break
                sums = yield Level(self.base, self.trees, feature, cut, nodes)
                for k, n in enumerate(nodes):
                    known[n] = sums[:, :, k]
                    if level:
                        known[n - 1 if n % 2 == 0 else n + 1] = known[(n - 1) // 2] - known[n]
                    else:
                        total[:, 0] = known[0][:, 0].sum(axis=-1) / UNITS
                for n in range(first, 2 * first + 1):
                    if n in known and total[2, n] >= 2 * least:
                        self._split(n, np.cumsum(known[n], axis=-1) / UNITS.reshape(3, 1, 1), feature, cut, total, ridge, least)
            ended = (feature < 0) & (total[2] > 0)
            self.trees.append((feature, cut, np.where(ended, rate * total[0] / (total[1] + ridge), 0.0)))

    @staticmethod
    def _split(n: int, left: np.ndarray, feature: np.ndarray, cut: np.ndarray, total: np.ndarray, ridge: float, least: float) -> None:
        """Split node ``n`` where the gain is greatest, if there is any; ``left`` sums up to each bin."""
        g, h, rows = total[:, n]
        lg, lh, ln = left
        gain = lg**2 / (lh + ridge) + (g - lg) ** 2 / (h - lh + ridge) - g**2 / (h + ridge)
        gain[(ln < least) | (rows - ln < least)] = -1
        k, j = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[k, j] > 1e-6:
            feature[n], cut[n] = k, j
            total[:, 2 * n + 1] = left[:, k, j]
            total[:, 2 * n + 2] = total[:, n] - left[:, k, j]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return scores(self.base, self.trees, self.binned(x))

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> Trees:
        """Platt scaling on held-out rows: probability = sigmoid(slope * raw + shift)."""
        raw = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            d, w = p - y, np.maximum(p * (1 - p), 1e-6)
            grad = np.array([(d * raw).sum() + ridge * (a - 1), d.sum() + ridge * b])
            hess = np.array([[(w * raw * raw).sum() + ridge, (w * raw).sum()], [(w * raw).sum(), w.sum() + ridge]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        if a > 0:
            self.slope, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))
