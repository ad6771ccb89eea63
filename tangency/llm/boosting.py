"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth; node i has children 2i + 1 and 2i + 2, and a row goes right if its value exceeds the cut."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out

    def compact(self) -> tuple[np.ndarray, Trees]:
        """The features that are read, and the same trees over those alone."""
        used, place = np.unique(self.feature, return_inverse=True)
        return used, Trees(place.reshape(self.feature.shape), self.cut, self.value, self.base)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 70, depth: int = 4, rate: float = 0.25, bins: int = 24, shrink: float = 2.0, columns: float = 0.7, rows: float = 0.5, seed: int = 1) -> Trees:
    """Newton boosting of the logistic loss; a tree's splits are the best of ``bins`` quantile cuts of a seeded share of the features, on a seeded share of the rows."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left").astype(np.int16) for j, c in enumerate(cuts)], axis=1)
    rng = np.random.default_rng(seed)
    some = max(1, int(columns * width))
    base = float(np.log((weight[y == 1].sum() + 1e-9) / (weight[y == 0].sum() + 1e-9)))
    margin = np.full(n, base)
    inner = (1 << depth) - 1
    features, limits, values = [], [], []
    for _ in range(trees):
        drawn = rng.choice(width, some, replace=False)
        part = np.flatnonzero(rng.random(n) < rows)
        cell = binned[part[:, None], drawn] + np.arange(some) * bins
        p = 1 / (1 + np.exp(-margin[part]))
        g, h = weight[part] * (p - y[part]), weight[part] * p * (1 - p)
        node, every = np.zeros(len(part), np.int64), np.zeros(n, np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (some * bins) + cell).ravel()
            sums = [np.bincount(at, np.repeat(v, some), count * some * bins).reshape(count, some, bins).cumsum(2) for v in (g, h)]
            left_g, left_h = sums[0][:, :, :-1], sums[1][:, :, :-1]
            all_g, all_h = sums[0][:, :, -1:], sums[1][:, :, -1:]
            gain = left_g**2 / (left_h + shrink) + (all_g - left_g) ** 2 / (all_h - left_h + shrink) - all_g**2 / (all_h + shrink)
            best = gain.reshape(count, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                j, c = divmod(b, bins - 1)
                own = cuts[drawn[j]]
                if gain[k, j, c] > 1e-6 and c < len(own):
                    feature[first + k], limit[first + k] = drawn[j], own[c]
            every = 2 * every + 1 + (x[np.arange(n), feature[every]] > limit[every])
            node = every[part]
        leaf = node - inner
        sums = [np.bincount(leaf, v, 1 << depth) for v in (g, h)]
        value = -rate * sums[0] / (sums[1] + shrink)
        margin += value[every - inner]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Trees(np.array(features), np.array(limits), np.array(values), base)
