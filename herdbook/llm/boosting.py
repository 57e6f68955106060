"""Gradient-boosted trees for two classes, on binned features, in numpy: trained on a bounded sample, applied in workers."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting with depth-limited trees over quantile bins; trees are arrays, so prediction is a few takes a level."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: float = 4.0, l2: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.used: list[int] = []
        self.start = 0.0

    @classmethod
    def of(cls, state: dict) -> BoostedTrees:
        """The model of which vars() gave this state."""
        made = cls()
        made.__dict__.update(state)
        return made

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.int16)
        for j in self.used:
            out[:, j] = np.searchsorted(self.edges[j], x[:, j], "right")
        return out

    @staticmethod
    def _edges(column: np.ndarray, bins: int) -> np.ndarray:
        """Bounds of bins: between all values if they are few, so that rare flags can be told; quantiles otherwise."""
        values = np.unique(column)
        if len(values) <= bins:
            return (values[1:] + values[:-1]) / 2
        return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        """x: rows by features; y: 0 or 1. Deterministic."""
        w = np.ones(len(y)) if weight is None else weight
        self.edges = [self._edges(x[:, j], self.bins) for j in range(x.shape[1])]
        self.used = [j for j, e in enumerate(self.edges) if len(e)]
        b = self._binned(x)
        mean = min(0.99, max(0.01, float((w * y).sum() / w.sum())))
        self.start = float(np.log(mean / (1 - mean)))
        f = np.full(len(y), self.start)
        leaves = 1 << self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), w * p * (1 - p)
            feature, cut = np.zeros(leaves, int), np.full(leaves, self.bins + 1)
            node = np.ones(len(y), int)
            for level in range(self.depth):
                first = 1 << level
                at = node - first
                best = np.full(first, 1e-6)
                for j in self.used:
                    key = at * (self.bins + 1) + b[:, j]
                    gs = np.bincount(key, g, first * (self.bins + 1)).reshape(first, -1).cumsum(1)
                    hs = np.bincount(key, h, first * (self.bins + 1)).reshape(first, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(first), top] > best
                    best = np.where(better, gain[np.arange(first), top], best)
                    feature[first:2 * first] = np.where(better, j, feature[first:2 * first])
                    cut[first:2 * first] = np.where(better, top, cut[first:2 * first])
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - leaves
            value = self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.l2)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        self.used = sorted({int(j) for feature, cut, _ in self.trees for j, c in zip(feature, cut) if c <= self.bins})
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of class 1."""
        b = self._binned(x)
        rows = np.arange(len(x))
        f = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            f += value[node - len(value)]
        return f
