"""Gradient-boosted trees over dense features (histograms, logistic loss) and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees in heap order; leaf values are Newton steps."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, leaf: int = 5, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf, self.l2 = trees, depth, rate, bins, leaf, l2
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        f = np.full(len(y), self.base)
        inner, size, d = (1 << self.depth) - 1, self.bins + 1, x.shape[1]
        shift = np.arange(d) * size
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for at in range(inner):
                rows = np.flatnonzero(node == at)
                split = None
                if len(rows) >= 2 * self.leaf:
                    key = (code[rows] + shift).ravel()
                    hist = [np.bincount(key, np.repeat(w, d), d * size).reshape(d, size).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows)))]
                    (gl, hl, nl), (gt, ht, nt) = hist, (a[:, -1:] for a in hist)
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(nl < self.leaf) | (nt - nl < self.leaf)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        split = divmod(best, size)
                if split and split[1] < len(self.edges[split[0]]):
                    feature[at], cut[at] = split[0], self.edges[split[0]][split[1]]
                    node[rows] = 2 * at + 1 + (x[rows, split[0]] > cut[at])
                else:
                    node[rows] = 2 * at + 1
            value = np.zeros(inner + 1)
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value = self.rate * gs / (hs + self.l2)
            self.nodes.append((feature, cut, value))
            f += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        inner, rows = (1 << self.depth) - 1, np.arange(len(x))
        for feature, cut, value in self.nodes:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            f += value[node - inner]
        return f


class Isotonic:
    """Pool-adjacent-violators with one pseudo-count each way at the ends, linear between knots."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        blocks: list[list[float]] = []  # mean, weight, lowest score, highest score
        for v, t in sorted(zip(s.tolist(), y.tolist(), strict=True)):
            blocks.append([t, 1.0, v, v])
            while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
                m, w, _, hi = blocks.pop()
                a = blocks[-1]
                a[0], a[1], a[3] = (a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, hi
        self.x, self.y = [], []
        for m, w, lo, hi in blocks:
            m = (m * w + 0.5) / (w + 1) if 0 < m < 1 else (m * w + (0.25 if m == 0 else 0.75)) / (w + 1)
            self.x += [lo, hi] if hi > lo else [lo]
            self.y += [m, m] if hi > lo else [m]
        self.y = np.maximum.accumulate(self.y) if self.y else []
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.x, self.y) if len(self.x) else np.zeros(len(s))
