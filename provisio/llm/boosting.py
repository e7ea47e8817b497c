"""Gradient-boosted trees for two classes on numpy arrays: logistic loss, histograms of feature values, full trees of a
fixed depth.  For training sets of bounded size; prediction runs in any task."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 100, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.feature = np.zeros((trees, (1 << depth) - 1), np.int32)
        self.limit = np.full((trees, (1 << depth) - 1), np.inf, np.float32)
        self.leaf = np.zeros((trees, 1 << depth), np.float32)
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        if not n:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])).astype(np.float32) for j in range(k)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        width = self.bins
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        flat = binned + np.arange(k) * width
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                nodes = 1 << level
                key = (flat + (node * k * width)[:, None]).ravel()
                shape = (nodes, k, width)
                g = np.cumsum(np.bincount(key, np.repeat(grad, k), nodes * k * width).reshape(shape), axis=2)
                h = np.cumsum(np.bincount(key, np.repeat(hess, k), nodes * k * width).reshape(shape), axis=2)
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g * g / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt * gt / (ht + self.ridge)
                gain[(h < 1) | (ht - h < 1)] = 0
                best = gain.reshape(nodes, -1).argmax(axis=1)
                f, b = best // width, best % width
                good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
                first = nodes - 1
                for i in np.flatnonzero(good):
                    self.feature[t, first + i], self.limit[t, first + i] = f[i], cuts[f[i]][b[i]]
                right = np.where(good[node], binned[np.arange(n), f[node]] > b[node], False)
                node = 2 * node + right
            g, h = np.bincount(node, grad, 1 << self.depth), np.bincount(node, hess, 1 << self.depth)
            self.leaf[t] = self.rate * g / (h + self.ridge)
            score += self.leaf[t][node]
        return self

    def chance(self, x: np.ndarray) -> np.ndarray:
        rows, score = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.limit[t][node])
            score += self.leaf[t][node - (1 << self.depth) + 1]
        return 1 / (1 + np.exp(-score))
