"""Gradient-boosted trees on small dense matrices, and isotonic calibration; numpy only.

Fitting is for bounded samples on the driver; prediction is vectorised and runs
in the workers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth, boosted on the logistic loss."""

    base: float = 0.0
    depth: int = 3
    features: list = field(default_factory=list)  # per tree: the feature of each inner node, -1 where it doesn't split
    cuts: list = field(default_factory=list)  # x <= cut goes left
    leaves: list = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((f[node] >= 0) & (x[rows, np.maximum(f[node], 0)] > c[node]))
            out += leaf[node - (2**self.depth - 1)]
        return out


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Candidate cuts for each feature: midpoints between its quantiles."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        if len(v) > most:
            v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most)))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 2.0, weight: np.ndarray | None = None) -> Trees:
    """Boost on the logistic loss with second-order leaves; every tie goes to the first feature and cut. A row counts ``weight`` times."""
    weight = np.ones(len(y)) if weight is None else weight
    p = np.clip(np.average(y, weights=weight) if len(y) else 0.0, 1e-4, 1 - 1e-4)
    model = Trees(base=float(np.log(p / (1 - p))), depth=depth)
    if not len(y) or y.min() == y.max():
        return model
    cuts = _bins(x, bins)
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw = np.full(len(x), model.base)
    inner, size = 2**depth - 1, bins + 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        f, c, node = np.full(inner, -1), np.zeros(inner), np.zeros(len(x), int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(width)
            split = np.zeros(width, int)
            for j, cut in enumerate(cuts):
                if not len(cut):
                    continue
                k = at * size + binned[:, j]
                gs = np.bincount(k, g, width * size).reshape(width, size).cumsum(axis=1)
                hs = np.bincount(k, h, width * size).reshape(width, size).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain = gain[:, : len(cut)]
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best + 1e-9
                best = np.where(better, gain[np.arange(width), top], best)
                f[first : first + width] = np.where(better, j, f[first : first + width])
                split = np.where(better, top, split)
            for i in range(width):
                if f[first + i] >= 0:
                    c[first + i] = cuts[f[first + i]][split[i]]
            fj = f[node]
            node = 2 * node + 1 + ((fj >= 0) & (binned[np.arange(len(x)), np.maximum(fj, 0)] > split[at]))
        leaf = node - inner
        values = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        raw += values[leaf]
        model.features.append(f)
        model.cuts.append(c)
        model.leaves.append(values)
    return model


@dataclass
class Isotonic:
    """A non-decreasing piecewise linear map from raw scores to probabilities."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
    """Pool adjacent violators; blocks are joined by lines between their mean scores. Without rows: the logistic map. A row counts ``weight`` times."""
    if not len(raw):
        x = np.linspace(-8, 8, 65)
        return Isotonic(x, 1 / (1 + np.exp(-x)))
    order = np.argsort(raw, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight
    blocks: list[list[float]] = []  # sums of y, weight and x
    for x, t, w in zip(raw[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([t * w, w, x * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], a, strict=True)]
    n = np.array([b[1] for b in blocks], float)
    mean = np.array([b[0] for b in blocks]) / n
    soft = (mean * n + 0.5 * np.where(mean >= 0.5, 0.99, 0.01)) / (n + 0.5)  # half an imagined row keeps off 0 and 1
    return Isotonic(np.array([b[2] for b in blocks]) / n, np.maximum.accumulate(soft))
