"""Gradient-boosted trees in numpy: logistic loss, histogram splits, complete trees of a fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Trees in heap order: feature and threshold of each inner node, value of each leaf (tree, node)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Newton boosting; splits at quantiles of each feature. Deterministic."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    score, inner = np.full(n, base), (1 << depth) - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, at = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            local = at - first
            best = np.zeros(wide)
            choice = np.zeros(wide, dtype=np.int64)
            cut = np.full(wide, -1, dtype=np.int64)
            for j in range(d):
                key = local * bins + binned[:, j]
                gs = np.bincount(key, weights=g, minlength=wide * bins).reshape(wide, bins).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=wide * bins).reshape(wide, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain = gain[:, : len(cuts[j])]
                if gain.shape[1]:
                    k = gain.argmax(axis=1)
                    value = gain[np.arange(wide), k]
                    better = value > best + 1e-9
                    best, choice, cut = np.where(better, value, best), np.where(better, j, choice), np.where(better, k, cut)
            for node in range(wide):
                if cut[node] >= 0:
                    feature[first + node], threshold[first + node] = choice[node], cuts[choice[node]][cut[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        gl = np.bincount(at - inner, weights=g, minlength=inner + 1)
        hl = np.bincount(at - inner, weights=h, minlength=inner + 1)
        value = -rate * gl / (hl + ridge)
        score += value[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Boosted(base, np.array(features), np.array(thresholds), np.array(leaves))
