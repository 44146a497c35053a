"""Gradient-boosted trees on histograms, in numpy; fitted offline, applied in batches."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier: depth-limited trees on the logistic loss, with Platt calibration."""

    def __init__(self, n_trees: int = 60, depth: int = 4, rate: float = 0.2, min_leaf: float = 4.0, l2: float = 1.0, bins: int = 32):
        self.n_trees, self.depth, self.rate, self.min_leaf, self.l2, self.bins = n_trees, depth, rate, min_leaf, l2, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.a, self.b, self.threshold = 0.0, 1.0, 0.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        x, y = np.asarray(x, np.float32), np.asarray(y, np.float64)
        weight = np.ones(len(y)) if weight is None else weight
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        p = np.clip((y * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self._tree(binned, edges, (p - y) * weight, np.maximum(p * (1 - p), 1e-9) * weight, score))
        return self

    def _tree(self, binned, edges, g, h, score):
        size = (1 << (self.depth + 1)) - 1
        feature, cut, value = np.full(size, -1, np.int32), np.zeros(size, np.float32), np.zeros(size, np.float64)
        node = np.zeros(len(g), np.int32)
        for n in range(size):
            at = np.flatnonzero(node == n)
            if not len(at):
                continue
            gs, hs = g[at].sum(), h[at].sum()
            value[n] = -self.rate * gs / (hs + self.l2)
            if n >= (1 << self.depth) - 1 or len(at) < 2:
                continue
            best, where = 1e-6, None
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[at, j]
                gl, hl = np.cumsum(np.bincount(b, g[at], len(e) + 1))[:-1], np.cumsum(np.bincount(b, h[at], len(e) + 1))[:-1]
                count = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                gain[(count < self.min_leaf) | (len(at) - count < self.min_leaf)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, where = gain[k], (j, k)
            if where:
                j, k = where
                feature[n], cut[n] = j, edges[j][k]
                node[at] = np.where(binned[at, j] <= k, 2 * n + 1, 2 * n + 2)
        score += value[node]
        return feature, cut, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float32)
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
            score += value[node]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on rows that were not fitted, then the threshold of the best F1."""
        s, y = self.raw(x), np.asarray(y, np.float64)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w, d = p * (1 - p) + 1e-9, p - y
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([(d * s).sum() + 1e-3 * (a - 1), d.sum() + 1e-3 * b]))
            a, b = a - step[0], b - step[1]
        self.a, self.b = float(a), float(b)
        p = self.predict(x)
        cuts = np.linspace(0.05, 0.95, 91)
        f1 = [2 * (y * (p >= c)).sum() / max(1.0, (p >= c).sum() + y.sum()) for c in cuts]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        self.threshold = float(cuts[best[len(best) // 2]])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -40, 40))) if len(x) else np.zeros(0)

    def to_dict(self) -> dict:
        trees = [[f.tolist(), [round(float(c), 5) for c in t], [round(float(v), 5) for v in w]] for f, t, w in self.trees]
        return {"depth": self.depth, "base": self.base, "a": self.a, "b": self.b, "threshold": self.threshold, "trees": trees}

    @classmethod
    def from_dict(cls, d: dict) -> BoostedTrees:
        m = cls(depth=d["depth"])
        m.base, m.a, m.b, m.threshold = d["base"], d["a"], d["b"], d["threshold"]
        m.trees = [(np.array(f, np.int32), np.array(t, np.float32), np.array(w)) for f, t, w in d["trees"]]
        return m
