"""Gradient-boosted regression trees for a yes-or-no target, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Boosted:
    """Trees of one depth as arrays: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (v.size - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Logistic loss, Newton steps; splits at quantiles of each feature. Without rows: a constant no."""
    if not len(x):
        return Boosted(-10.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)))
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    score, trees = np.full(len(x), base), []
    inner = 2**depth - 1
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best = 1e-9
            cut = None
            if len(at):
                total_g, total_h = g[at].sum(), h[at].sum()
                for j in range(x.shape[1]):
                    if not len(cuts[j]):
                        continue
                    gl = np.cumsum(np.bincount(bins[at, j], g[at], len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins[at, j], h[at], len(cuts[j]) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                    b = int(gain.argmax())
                    if gain[b] > best:
                        best, cut = gain[b], (j, cuts[j][b])
            if cut:
                feature[k], threshold[k] = cut
            right = x[at, feature[k]] > threshold[k]
            node[at] = 2 * k + 1 + right
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += value[leaf]
        trees.append((feature, threshold, value))
    return Boosted(base, *(np.stack(c) for c in zip(*trees)))
