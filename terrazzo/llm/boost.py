"""Gradient-boosted trees for a binary target, in numpy (histograms of quantile bins)."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Trees of fixed depth on binned features; logistic loss, Newton leaves."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.l2 = trees, depth, rate, l2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "BoostedTrees":
        n, d = x.shape
        weight = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        binned = self._binned(x)
        mean = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        z = np.full(n, self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, BINS, np.int64)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                local = node - first
                best = np.full(width, 1e-9)
                for j in range(d):
                    at = local * BINS + binned[:, j]
                    left_g = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    left_h = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    gain = left_g**2 / (left_h + self.l2) + (all_g - left_g) ** 2 / (all_h - left_h + self.l2) - all_g**2 / (all_h + self.l2)
                    gain[:, -1] = 0
                    gain[(left_h < 0.5) | (all_h - left_h < 0.5)] = 0
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(width), k] > best
                    best[better] = gain[np.arange(width), k][better]
                    feature[first : first + width][better], cut[first : first + width][better] = j, k[better]
                node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            z += value[leaf]
            self.splits.append((feature, cut, value))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._binned(x), np.arange(len(x))
        z = np.full(len(x), self.start)
        for feature, cut, value in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            z += value[node - (2**self.depth - 1)]
        return z
