"""Gradient-boosted trees for two classes over dense features, and isotonic calibration, in numpy.

Fitted on the driver over a sample whose size is bounded by the caller's parameter; applied row by row on executors.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Second-order boosting of depth-limited trees with binned thresholds and logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        nodes = (1 << self.depth) - 1
        self.feature, self.cut = np.zeros((self.trees, nodes), np.int64), np.full((self.trees, nodes), np.inf)
        self.leaf = np.zeros((self.trees, nodes + 1))
        score = np.full(n, self.base)
        cells = f * self.bins
        offset = np.arange(f) * self.bins
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)  # within its level
            for d in range(self.depth):
                width = 1 << d
                at = (node[:, None] * cells + offset + binned).ravel()
                gs, hs = (np.bincount(at, np.repeat(v, f), width * cells).reshape(width, f, self.bins).cumsum(2) for v in (g, h))
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gl, hl = gs[:, :, :-1], hs[:, :, :-1]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
                j, b = best // (self.bins - 1), best % (self.bins - 1)
                for k in np.flatnonzero(good):
                    self.feature[t, width - 1 + k], self.cut[t, width - 1 + k] = j[k], self.cuts[j[k]][b[k]] if b[k] < len(self.cuts[j[k]]) else np.inf
                go = good[node] & (binned[np.arange(n), j[node]] > b[node])
                node = 2 * node + go
            gs, hs = np.bincount(node, g, nodes + 1), np.bincount(node, h, nodes + 1)
            self.leaf[t] = -self.rate * gs / (hs + self.l2)
            score += self.leaf[t][node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            out += leaf[node - len(feature)]
        return out


class Isotonic:
    """Pool-adjacent-violators fit, linear between block centres, with a small slope so that scores keep their order."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []
        for m, v in zip(margin[order].tolist(), y[order].tolist()):
            blocks.append([v, 1.0, m])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                v, w, m = blocks.pop()
                blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + w, blocks[-1][2] + m]
        self.x = np.array([m / w for _, w, m in blocks])
        self.p = np.array([v / w for v, w, _ in blocks])
        return self

    def apply(self, margin: np.ndarray) -> np.ndarray:
        return 0.999 * np.interp(margin, self.x, self.p) + 0.001 / (1 + np.exp(-margin))


def calibrated(make, x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> tuple[Boosted, Isotonic]:
    """A model of all rows, and the calibration of margins that models of the other folds give."""
    margin = np.zeros(len(y))
    for k in np.unique(folds):
        own = folds == k
        margin[own] = make().fit(x[~own], y[~own]).margin(x[own]) if (~own).any() else 0.0
    return make().fit(x, y), Isotonic().fit(margin, y)
