"""Gradient-boosted trees over a dense matrix, and isotonic calibration, for bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32
DEPTH = 3


@dataclass
class Forest:
    """Complete trees of one depth: inner node i has children 2i+1 and 2i+2; values are those of the last level."""

    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for features, limits, values in zip(self.features, self.limits, self.values, strict=True):
            node = np.zeros(len(x), int)
            while len(node) and node[0] < len(features):
                node = 2 * node + 1 + (x[rows, features[node]] > limits[node])
            total += values[node - len(features)]
        return total


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, rate: float = 0.2, least: float = 2.0, smooth: float = 1.0) -> Forest:
    """Boost on the logistic loss. Splits are sought among ``BINS`` quantiles of each feature.

    ``least`` is the least curvature (about four times the undecided rows) a side may have.
    """
    rate_of_one = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(float(np.log(rate_of_one / (1 - rate_of_one))))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, column) for e, column in zip(edges, x.T, strict=True)])
    score, inner = np.full(len(y), forest.start), 2**DEPTH - 1
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        slope, bend = y - chance, chance * (1 - chance)
        features, limits, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            for f in range(x.shape[1]) if len(rows) else ():
                g = np.bincount(binned[rows, f], slope[rows], BINS + 1)
                h = np.bincount(binned[rows, f], bend[rows], BINS + 1)
                g_low, h_low = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
                g_high, h_high = g.sum() - g_low, h.sum() - h_low
                gain = g_low**2 / (h_low + smooth) + g_high**2 / (h_high + smooth) - g.sum() ** 2 / (h.sum() + smooth)
                gain[(h_low < least / 4) | (h_high < least / 4)] = 0
                gain[len(edges[f]) :] = 0
                if (i := int(np.argmax(gain))) < len(edges[f]) and gain[i] > best:
                    best, features[at], limits[at] = gain[i], f, edges[f][i]
            node[rows] = 2 * at + 1 + (x[rows, features[at]] > limits[at])
        leaf = node - inner
        values = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + smooth)
        score += values[leaf]
        forest.features.append(features)
        forest.limits.append(limits)
        forest.values.append(values)
    return forest


@dataclass
class Isotonic:
    """A rising function from raw scores to chances, straight between the centres of its levels."""

    at: np.ndarray
    level: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        # A thousandth of the plain logistic value keeps the order within a level.
        return 0.999 * np.interp(raw, self.at, self.level) + 0.001 / (1 + np.exp(-raw))


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool neighbours that are out of order until the levels rise."""
    places, inverse = np.unique(raw, return_inverse=True)
    blocks: list[list[float]] = []  # sum of labels, rows, sum of places times rows
    for ones, n, place in zip(np.bincount(inverse, y), np.bincount(inverse), places, strict=True):
        blocks.append([ones, n, place * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return Isotonic(np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks]))
