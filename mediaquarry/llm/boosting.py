"""Gradient-boosted trees for a binary label, on histograms of binned features (NumPy only)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, trees of a fixed depth stored as arrays, so that a batch is scored level by level."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 48, ridge: float = 2.0, least: int = 20):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)
        base = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(base / (1 - base)))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.threshold = np.full((self.trees, inner), np.inf)
        self.value = np.zeros((self.trees, leaves))
        total = np.full(n, self.start)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                local = at - first
                best = np.zeros(count)
                for f in range(width):
                    slots = len(self.edges[f]) + 1
                    if slots < 2:
                        continue
                    cell = local * slots + binned[:, f]
                    gs, hs, ns = (np.bincount(cell, w, count * slots).reshape(count, slots) for w in (g, h, None))
                    gl, hl, nl = (np.cumsum(v, 1)[:, :-1] for v in (gs, hs, ns))
                    ga, ha, na = gs.sum(1)[:, None], hs.sum(1)[:, None], ns.sum(1)[:, None]
                    gain = gl**2 / (hl + self.ridge) + (ga - gl) ** 2 / (ha - hl + self.ridge) - ga**2 / (ha + self.ridge)
                    gain[(nl < self.least) | (na - nl < self.least)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(count), k]
                    for c in np.flatnonzero(top > best + 1e-9):
                        best[c] = top[c]
                        self.feature[t, first + c], self.threshold[t, first + c] = f, self.edges[f][k[c]]
                at = 2 * at + 1 + (x[np.arange(n), self.feature[t, at]] > self.threshold[t, at])
            leaf = at - inner
            self.value[t] = self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.ridge)
            total += self.value[t, leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), 2**self.depth - 1
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            out += self.value[t, at - inner]
        return out
