"""Gradient-boosted trees on binned features, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: for each inner node a feature and a threshold, for each leaf a value."""

    base: float
    depth: int
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), int))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds for each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - len(f)]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits lie at `bins` quantiles of a feature."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if not n or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    place = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # x > cut k exactly if its bin is over k
    flat = place + np.arange(width) * (bins + 1)
    raw, inner = np.full(n, model.base), 2**depth - 1
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = _sigmoid(raw)
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node, feature, threshold = np.zeros(n, int), np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * (bins + 1)) + flat).ravel()
            shape = (count, width, bins + 1)
            sums = [np.bincount(at, np.repeat(v, width), count * width * (bins + 1)).reshape(shape).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least * 0.05) | (ht - hl < least * 0.05)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins + 1)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        raw += value[leaf]
        grown.append((feature, threshold, value))
    model.features, model.thresholds, model.leaves = (np.array(part) for part in zip(*grown, strict=True))
    return model


@dataclass
class Isotonic:
    """An increasing function through the pooled means, straight between them."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.value)


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool-adjacent-violators of y in the order of raw; equal raw values are one point."""
    if not len(raw):
        return Isotonic(np.zeros(1), np.zeros(1))
    xs, where = np.unique(raw, return_inverse=True)
    weight, total = np.bincount(where).astype(float), np.bincount(where, y)
    blocks: list[list[float]] = []  # weight, sum, first x, last x
    for x, w, s in zip(xs, weight, total, strict=True):
        blocks.append([w, s, x, x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, _, last = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += s2
            blocks[-1][3] = last
    at, value = [], []
    for w, s, first, last in blocks:
        for x in dict.fromkeys((first, last)):
            at.append(x)
            value.append(s / w)
    return Isotonic(np.array(at), np.array(value))
