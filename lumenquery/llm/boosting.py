"""Gradient-boosted trees on histograms, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting with depth-wise trees over quantile bins."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j][x[:, j] != 0] if (x[:, j] != 0).any() else x[:, j], quantiles)) for j in range(x.shape[1])]
        b = self._binned(x)
        p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base, self.model = np.log(p / (1 - p)), []
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            self.model.append(tree := self._tree(b, p - y, np.maximum(p * (1 - p), 1e-6)))
            f += self._walk(tree, b)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Split feature and bin per inner node (a complete binary tree) and values of its leaves."""
        node = np.zeros(len(g), int)
        feature, cut = np.full(2**self.depth - 1, 0), np.full(2**self.depth - 1, self.bins)
        for level in range(self.depth):
            width, offset = 2**level, 2**level - 1
            best = np.zeros(width)
            gt, ht = np.bincount(node, g, width), np.bincount(node, h, width)
            for j in range(b.shape[1]):
                at = node * (self.bins + 1) + b[:, j]
                gl = np.cumsum(np.bincount(at, g, width * (self.bins + 1)).reshape(width, -1), axis=1)[:, :-1]
                hl = np.cumsum(np.bincount(at, h, width * (self.bins + 1)).reshape(width, -1), axis=1)[:, :-1]
                gr, hr = gt[:, None] - gl, ht[:, None] - hl
                gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - (gt**2 / (ht + self.l2))[:, None]
                gain[(hl < self.least) | (hr < self.least)] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best + 1e-9
                best[better] = gain[np.arange(width), k][better]
                feature[offset : offset + width][better] = j
                cut[offset : offset + width][better] = k[better]
            node = 2 * node + (b[np.arange(len(g)), feature[offset + node]] > cut[offset + node])
        leaves = 2**self.depth
        return feature, cut, -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)

    def _walk(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        rows = np.arange(len(b))
        for level in range(self.depth):
            at = 2**level - 1 + node
            node = 2 * node + (b[rows, feature[at]] > cut[at])
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return 1 / (1 + np.exp(-(self.base + sum(self._walk(t, b) for t in self.model))))


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone calibration of p to y by pooling adjacent violators."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # sum, number, lowest and highest score
    for q, t in zip(p[order], y[order], strict=True):
        blocks.append([t, 1, q, q])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    x = np.array([v for s in blocks for v in (s[2], s[3])])
    v = np.array([s[0] / s[1] for s in blocks for _ in range(2)])
    x, first = np.unique(x, return_index=True)
    return x, v[first]
