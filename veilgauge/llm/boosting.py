"""Gradient-boosted trees for small, bounded samples, with a calibrated threshold. Numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: per inner node a feature and a cut, per leaf a value."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -30, 30)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, bins: int, ridge: float, least: float, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
    node = np.zeros(len(x), np.int64)
    for level in range(depth):
        first, n = 2**level - 1, 2**level
        local = node - first
        best = np.full(n, 1e-6)
        for f in range(x.shape[1]):
            key = local * bins + x[:, f]
            gs = np.bincount(key, g, n * bins).reshape(n, bins).cumsum(1)
            hs = np.bincount(key, h, n * bins).reshape(n, bins).cumsum(1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = -1
            k = gain.argmax(1)
            top = gain[np.arange(n), k]
            better = top > best
            best[better] = top[better]
            feature[first : first + n][better] = f
            cut[first : first + n][better] = k[better]
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
    leaf = node - inner
    gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
    return feature, cut, -rate * gs / (hs + ridge)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0, holdout: int = 5) -> Trees:
    """Trees for features x (integers from 0 to 31) and labels y in {0, 1}.

    Every `holdout`-th row is held out: on those rows the margins are
    calibrated (logistic), and the threshold is the calibrated probability
    with the best F1.
    """
    x = np.clip(x, 0, 31).astype(np.int64)
    y = y.astype(float)
    held = np.arange(len(y)) % holdout == 0
    a, b = x[~held], y[~held]
    p = np.clip(b.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    f = np.full(len(b), base)
    parts = []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        tree = _grow(a, q - b, np.maximum(q * (1 - q), 1e-6), depth, 32, ridge, least, rate)
        parts.append(tree)
        f += Trees(0.0, *[t[None] for t in tree]).margin(a)
    model = Trees(base, *[np.stack([p[k] for p in parts]) for k in range(3)])
    m, t = model.margin(x[held]), y[held]
    w = np.array([1.0, 0.0])
    design = np.stack([m, np.ones_like(m)], 1)
    prior = np.array([1.0, 0.0])
    for _ in range(25):  # a weak prior keeps the fit finite where the classes are separated
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (q - t) + 0.5 * (w - prior)
        hess = (design * (q * (1 - q))[:, None]).T @ design + 0.5 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    model.calibration = (float(max(w[0], 0.1)), float(w[1]))
    q = model.probability(x[held])
    cuts = np.linspace(0.2, 0.8, 25)
    f1 = [2 * ((q >= c) & (t > 0)).sum() / max(1, (q >= c).sum() + t.sum()) for c in cuts]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    model.threshold = float(cuts[best[np.argmin(np.abs(cuts[best] - 0.5))]])
    return model
