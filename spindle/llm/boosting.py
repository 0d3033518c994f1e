"""Gradient-boosted trees for a binary label and isotonic calibration, in numpy.

For samples of bounded size on the driver; scoring runs anywhere.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth on quantile bins, fitted to the logistic loss by second-order steps."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, features = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(features)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        slot = binned + np.arange(features) * self.bins
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.value = np.zeros((self.trees, leaves))
        margin = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                k = 2**level
                at = (node[:, None] * (features * self.bins) + slot).ravel()
                shape = (k, features, self.bins)
                g = np.bincount(at, np.repeat(grad, features), k * features * self.bins).reshape(shape).cumsum(axis=2)
                h = np.bincount(at, np.repeat(hess, features), k * features * self.bins).reshape(shape).cumsum(axis=2)
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(h < self.least) | (ht - h < self.least)] = 0
                best = gain.reshape(k, -1).argmax(axis=1)
                f, b = best // self.bins, best % self.bins
                split = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
                for i in np.flatnonzero(split):
                    if b[i] < len(cuts[f[i]]):
                        self.feature[t, k - 1 + i], self.cut[t, k - 1 + i] = f[i], cuts[f[i]][b[i]]
                right = x[np.arange(n), self.feature[t, k - 1 + node]] > self.cut[t, k - 1 + node]
                node = 2 * node + right
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            self.value[t] = -self.rate * g / (h + self.ridge)
            margin += self.value[t][node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(self.trees)[None, :]
        node = np.zeros((len(x), self.trees), np.int64)
        for level in range(self.depth):
            at = 2**level - 1 + node
            node = 2 * node + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        return self.base + self.value[trees, node].sum(axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of ``y`` to ``x`` by pooling adjacent violators.

    A pool's mean is drawn towards the overall mean by one row's weight, so that no pool is certain.
    """
    order = np.argsort(x, kind="stable")
    x, y, prior = x[order], y[order].astype(float), float(np.mean(y))
    pools: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x.tolist(), y.tolist()):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, c, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][3] = last
    means = np.maximum.accumulate([(s + prior) / (c + 1) for s, c, _, _ in pools])
    return np.array([v for _, _, a, b in pools for v in (a, b)]), np.repeat(means, 2)
