"""Gradient-boosted trees on histograms, as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Complete binary trees of one depth. Node i has children 2i+1 and 2i+2; a row goes right if value > limit."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row: all rows walk down one level of a tree together."""
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, penalty: float = 2.0, least: float = 2.0
) -> Trees:
    """Fit log-loss by second-order boosting. No rows: a score of 0.5; one class: its smoothed share."""
    n, width = x.shape
    inner = 2**depth - 1
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(width)])  # bin b: edges[b-1] < value <= edges[b]
    margin, made = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            here = node - first
            gain = np.full(count, 1e-6)
            for f in range(width):
                cells = here * BINS + binned[f]
                g = np.cumsum(np.bincount(cells, grad, count * BINS).reshape(count, BINS), axis=1)
                h = np.cumsum(np.bincount(cells, hess, count * BINS).reshape(count, BINS), axis=1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                better = g**2 / (h + penalty) + rest_g**2 / (rest_h + penalty) - g[:, -1:] ** 2 / (h[:, -1:] + penalty)
                better[(h < least) | (rest_h < least)] = 0
                better = better[:, : len(edges[f])]
                if not better.shape[1]:
                    continue
                cut = better.argmax(axis=1)
                best = better[np.arange(count), cut]
                won = best > gain
                gain[won] = best[won]
                feature[first : first + count][won] = f
                limit[first : first + count][won] = edges[f][cut[won]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        at = node - inner
        g, h = np.bincount(at, grad, inner + 1), np.bincount(at, hess, inner + 1)
        leaf = -rate * g / (h + penalty)
        margin += leaf[at]
        made.append((feature, limit, leaf))
    return Trees(*(np.stack(a) for a in zip(*made, strict=True)), base)
