"""Gradient-boosted trees for a yes-or-no target, over binned features in numpy."""

from __future__ import annotations

import numpy as np

BINS = 24


class Boosted:
    """Trees of a fixed depth. A node's left child holds rows whose feature is at most its cut."""

    def __init__(self, depth: int = 4, trees: int = 60, rate: float = 0.25, least: float = 3.0, penalty: float = 1.0) -> None:
        self.depth, self.trees, self.rate, self.least, self.penalty = depth, trees, rate, least, penalty
        self.base = 0.0
        self.feature = np.zeros((0, 0), np.int64)
        self.cut = np.zeros((0, 0))
        self.leaf = np.zeros((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        flags = [j for j in range(d) if x[:, j].any() and not x[:, j].all() and np.isin(x[:, j], (0, 1)).all()]
        ones = x[:, flags].astype(np.float32)
        rest = sorted(set(range(d)) - set(flags))
        edges = {j: np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in rest}
        useful = [j for j, e in edges.items() if len(e) > 1 or len(e) and (x[:, j] > e[0]).any()]
        binned = {j: np.searchsorted(edges[j], x[:, j], "left") for j in useful}
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        self.feature, self.cut, self.leaf = np.zeros((self.trees, inner), np.int64), np.full((self.trees, inner), np.inf), np.zeros((self.trees, inner + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.full(width, 1e-6)
                ga, ha = np.bincount(node, g, width)[:, None], np.bincount(node, h, width)[:, None]

                def gains(gs: np.ndarray, hs: np.ndarray, ga: np.ndarray = ga, ha: np.ndarray = ha) -> np.ndarray:
                    gain = gs**2 / (hs + self.penalty) + (ga - gs) ** 2 / (ha - hs + self.penalty) - ga**2 / (ha + self.penalty)
                    gain[(hs < self.least) | (ha - hs < self.least)] = 0
                    return gain

                def take(gain: np.ndarray, split, first: int = first, t: int = t, best: np.ndarray = best) -> None:
                    at = gain.argmax(axis=1)
                    for k in np.flatnonzero(gain[np.arange(len(gain)), at] > best):
                        if (found := split(at[k])) is not None:
                            best[k] = gain[k, at[k]]
                            self.feature[t, first + k], self.cut[t, first + k] = found

                if flags:
                    own = np.zeros((2 * width, n), np.float32)
                    own[node, np.arange(n)], own[width + node, np.arange(n)] = g, h
                    sums = (own @ ones).astype(float)
                    take(gains(ga - sums[:width], ha - sums[width:]), lambda at: (flags[at], 0.0))
                for j in useful:
                    key = node * BINS + binned[j]
                    gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    take(gains(gs, hs), lambda at, e=edges[j], j=j: (j, e[at]) if at < len(e) else None)
                node = 2 * node + (x[np.arange(n), self.feature[t, first + node]] > self.cut[t, first + node])
            total, weight = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
            self.leaf[t] = -self.rate * total / (weight + self.penalty)
            margin += self.leaf[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of yes."""
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            margin += leaf[node]
        return 1 / (1 + np.exp(-margin))
