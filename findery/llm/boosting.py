"""Gradient-boosted trees on the logistic loss: histogram splits, fixed depth, numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """``feature`` and ``cut`` of each inner node, ``value`` of each leaf, in heap order, a row for each tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        depth = int(np.log2(self.value.shape[1]))
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (len(value) - 1)]
        return out


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 32,
    ridge: float = 1.0,
) -> Boosted:
    """Fits ``trees`` trees to labels 0 and 1. Equal input gives an equal model."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = bins + 1
    offset = np.arange(k) * width
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    features, cuts, values = [], [], []
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = p - y, p * (1 - p)
        feature, cut, cut_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, width)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            cells = (((at - first) * (k * width))[:, None] + offset + binned).ravel()
            size = nodes * k * width
            g = np.bincount(cells, np.repeat(gradient, k), size).reshape(nodes, k, width).cumsum(axis=2)
            h = np.bincount(cells, np.repeat(hessian, k), size).reshape(nodes, k, width).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < 1e-3) | (ht - h < 1e-3)] = 0
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(axis=1)
            for node in range(nodes):
                if flat[node, best[node]] > 1e-6:
                    j, b = divmod(int(best[node]), width)
                    if b < len(edges[j]):
                        feature[first + node], cut[first + node], cut_bin[first + node] = j, edges[j][b], b
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut_bin[at])
        leaf = at - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, hessian, inner + 1)
        value = -rate * g / (h + ridge)
        score += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Boosted(base, np.array(features), np.array(cuts), np.array(values))
