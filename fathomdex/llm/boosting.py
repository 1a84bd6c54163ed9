"""Gradient-boosted trees for a binary label, with isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of fixed depth over binned features, fitted to the gradient of the log loss."""

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.15, least: float = 1.0):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least
        self.base, self.nodes, self.edges = 0.0, [], []
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, dtype=int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
        if not 0 < y.sum() < len(y):
            return self
        b, f = self._binned(x), np.full(len(x), self.base)
        width = x.shape[1]
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            where = np.zeros(len(x), dtype=int)
            tree = []  # per level: feature and last bin that goes left, for each node
            for level in range(self.depth):
                n = 1 << level
                best = np.full(n, -1.0), np.zeros(n, dtype=int), np.full(n, BINS)
                for j in range(width):
                    key = where * BINS + b[:, j]
                    sg = np.bincount(key, g, n * BINS).reshape(n, BINS).cumsum(axis=1)
                    sh = np.bincount(key, h, n * BINS).reshape(n, BINS).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + self.least) + (tg - sg) ** 2 / (th - sh + self.least) - tg**2 / (th + self.least)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(n), k]
                    better = top > best[0] + 1e-9
                    best[0][better], best[1][better], best[2][better] = top[better], j, k[better]
                tree.append((best[1], best[2]))
                where = where * 2 + (b[np.arange(len(x)), best[1][where]] > best[2][where])
            n = 1 << self.depth
            leaf = self.rate * np.bincount(where, g, n) / (np.bincount(where, h, n) + self.least)
            self.nodes.append((tree, leaf))
            f += leaf[where]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for tree, leaf in self.nodes:
            where = np.zeros(len(x), dtype=int)
            for feature, cut in tree:
                where = where * 2 + (b[rows, feature[where]] > cut[where])
            f += leaf[where]
        return f

    def calibrate(self, margins: np.ndarray, y: np.ndarray) -> "Boosted":
        """Isotonic regression of the label on margins of rows that the trees they are from were not fitted to."""
        if 0 < y.sum() < len(y):
            self.knots = isotonic(margins, y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = self.margin(x)
        plain = 1 / (1 + np.exp(-f))
        if self.knots is None:
            return plain
        # a small part of the uncalibrated score keeps an order among rows of one step
        return np.clip(0.999 * np.interp(f, *self.knots) + 0.001 * plain, 0, 1)


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: the knots of the rising step function, each block at its mean margin."""
    order = np.argsort(f, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for k in order:
        blocks.append([float(y[k]), 1.0, float(f[k])])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
