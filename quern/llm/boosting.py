"""Gradient-boosted regression trees on numpy arrays (logistic loss, Newton steps)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """A sum of depth-limited trees; ``fit`` is deterministic."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p) + 1e-9, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, x, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = ("leaf", self.rate * total_g / (total_h + 1.0))
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
            gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
            ok = v[1:] > v[:-1]
            ok[: self.least - 1] = False
            ok[len(ok) - self.least + 1 :] = False
            if ok.any():
                k = int(np.where(ok, gain, -1).argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] is None:
            return leaf
        _, f, cut = best
        left = x[rows, f] <= cut
        return ("split", f, cut, self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if tree[0] == "leaf":
            return np.full(len(x), tree[1])
        _, f, cut, low, high = tree
        left = x[:, f] <= cut
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(low, x[left]), self._walk(high, x[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for tree in self.trees:
            margin += self._walk(tree, x)
        return 1 / (1 + np.exp(-margin))
