"""Gradient-boosted trees for a binary label, with isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Full binary trees in arrays: a node's children are 2i + 1 and 2i + 2; rows above the threshold go right."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    knots: np.ndarray | None = None  # raw scores at which the calibrated probability is known
    levels: np.ndarray | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before calibration, by row of x."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1, between 0 and 1."""
        raw = self.raw(x)
        if self.knots is None:
            return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return np.clip(np.interp(raw, self.knots, self.levels), 0, 1)

    def calibrate(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Isotonic regression of the label on raw scores by pooling adjacent violators; ties are pooled first.

        Half a pseudo-row of the mean label in each block keeps its level off 0 and 1.
        """
        at, inverse = np.unique(raw, return_inverse=True)
        blocks: list[list[float]] = []  # weight, weighted label, weighted score
        for w, wy, wx in zip(np.bincount(inverse, weight), np.bincount(inverse, weight * y), np.bincount(inverse, weight * raw)):
            blocks.append([w, wy, wx])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        table = np.array(blocks)
        self.knots = table[:, 2] / table[:, 0]
        self.levels = (table[:, 1] + 0.5 * np.average(y, weights=weight)) / (table[:, 0] + 0.5)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0) -> Boosted:
    """Boosted trees for logistic loss by Newton steps over feature histograms. Deterministic."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    mean = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    start = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    score, rows = np.full(n, start), np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = weight * (y - p), weight * p * (1 - p)
        node, cut = np.zeros(n, np.int64), np.full(inner, bins + 1)
        for first in (2**d - 1 for d in range(depth)):
            width = first + 1
            local = node - first
            best = np.full(width, 1e-6)
            for j in range(f):
                key = local * (bins + 1) + binned[:, j]
                g = np.bincount(key, grad, width * (bins + 1)).reshape(width, -1)
                h = np.bincount(key, hess, width * (bins + 1)).reshape(width, -1)
                gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[:, len(cuts[j]) :] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    feature[t, first + k], threshold[t, first + k], cut[first + k] = j, cuts[j][at[k]], at[k]
            node = 2 * node + 1 + (binned[rows, feature[t, node]] > cut[node])
        node -= inner
        leaf[t] = rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + ridge)
        score += leaf[t][node]
    return Boosted(start, feature, threshold, leaf)
