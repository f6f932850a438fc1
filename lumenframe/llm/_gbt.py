"""Histogram gradient-boosted trees for binary labels, flattened into arrays.

Features are cut into at most 64 bins at quantiles of the training rows, half
way to the next value; trees
grow level by level on summed gradients of the log loss; all trees' nodes stand
in flat arrays, and prediction moves all rows down one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node k of tree t: rows with feature[t, k] <= cut[t, k] go to 2k + 1, others to 2k + 2; leaves carry value."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def _between(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Half way from each cut to the next value of the training rows, so that values between the two go to the nearer side."""
    known = np.unique(values)
    return (cuts + known[np.minimum(np.searchsorted(known, cuts, "right"), len(known) - 1)]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, l2: float = 1.0) -> Trees:
    """Train on rows ``x`` with labels ``y`` (0 or 1). Without rows or with one class only the score is constant."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, total = (1 << depth) - 1, (1 << (depth + 1)) - 1
    width = max(1, x.shape[1] if x.ndim == 2 else 1)
    if n < 2 * least or y.min() == y.max():
        return Trees(base, np.zeros((0, total), dtype=np.int64), np.zeros((0, total)), np.zeros((0, total)), depth)
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="lower")) for f in range(width)]
    between = [_between(x[:, f], c) for f, c in enumerate(cuts)]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # code <= b: x <= cuts[b]
    offset = np.arange(width) * bins
    raw = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        feature, cut, value = np.zeros(total, dtype=np.int64), np.full(total, np.inf), np.zeros(total)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            place = ((node - first)[:, None] * width * bins + offset + code).reshape(-1)
            size = many * width * bins

            def summed(w: np.ndarray) -> np.ndarray:
                return np.bincount(place, weights=np.repeat(w, width), minlength=size).reshape(many, width, bins).cumsum(axis=2)

            g, h, c = summed(grad), summed(hess), summed(np.ones(n))
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(c < least) | (ct - c < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, between[f][b]
            at = node
            node = 2 * node + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = node - inner
        g = np.bincount(leaf, weights=grad, minlength=1 << depth)
        h = np.bincount(leaf, weights=hess, minlength=1 << depth)
        value[inner:] = rate * g / (h + l2)
        raw += value[node]
        features.append(feature), thresholds.append(cut), values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values), depth)
