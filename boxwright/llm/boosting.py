"""Gradient-boosted regression trees with logistic loss on binned features, in numpy: fitted on the driver, applied in tasks."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """Complete binary trees of equal depth: inner nodes test feature > threshold, leaves hold log-odds steps."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 45, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Each tree splits level by level on the best gain of binned Newton sums; ties go to the first feature and bin."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z = np.full(n, bias)
    inner, features, thresholds, leaves = (1 << depth) - 1, [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, base = 1 << level, (1 << level) - 1
            local = node - base
            best, where = np.zeros(width), [(0, np.inf)] * width
            for j in range(d):
                if not len(edges[j]):
                    continue
                cell, m = local * bins + binned[:, j], width * bins
                gs, hs = np.bincount(cell, g, m).reshape(width, bins).cumsum(1), np.bincount(cell, h, m).reshape(width, bins).cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                gain = gain[:, : len(edges[j])]
                at = gain.argmax(1)
                for w in range(width):
                    if gain[w, at[w]] > best[w] + 1e-9:
                        best[w], where[w] = gain[w, at[w]], (j, float(edges[j][at[w]]))
            for w, (j, cut) in enumerate(where):
                feature[base + w], threshold[base + w] = j, cut
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        local, count = node - inner, 1 << depth
        step = rate * np.bincount(local, g, count) / (np.bincount(local, h, count) + ridge)
        z += step[local]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(step)
    return Trees(bias, np.array(features), np.array(thresholds), np.array(leaves))


def log_odds(trees: Trees, x: np.ndarray) -> np.ndarray:
    rows, z = np.arange(len(x)), np.full(len(x), trees.bias)
    inner = trees.feature.shape[1]
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < inner:
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        z += leaf[node - inner]
    return z
