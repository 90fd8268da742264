"""Gradient-boosted trees on numpy arrays: logistic loss, histogram splits, monotonic constraints.

All trees lie flattened in four arrays (feature, threshold, left child, value) with children next to each other, so
a table of rows is scored by stepping all rows and trees down together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS, DEPTH, RATE, BINS, L2, LEAST = 60, 3, 0.2, 64, 1.0, 5.0


@dataclass
class Forest:
    """``feature`` is -1 in leaves; the children of node i are left[i] and left[i] + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(feature, 0)] > self.threshold[at]
            at = np.where(inner, self.left[at] + right, at)
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def bin_edges(column: np.ndarray) -> np.ndarray:
    """Cut points between bins of about equal counts."""
    return np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))


class Grower:
    """Grows one tree after the other on binned features."""

    def __init__(self, x: np.ndarray, monotone: list[int]):
        self.edges = [bin_edges(c) for c in x.T]
        self.bins = np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        self.monotone = monotone
        self.nodes: list[list[float]] = []  # feature, threshold, left, value

    def best_split(self, rows, g, h, low, high):
        """(gain, feature, bin, left value, right value) of the best allowed split, or None."""

        def value(gs, hs):
            return np.clip(-gs / (hs + L2), low, high)

        def gain(gs, hs, v):
            return -(gs * v + 0.5 * (hs + L2) * v * v)

        g_all, h_all = g[rows].sum(), h[rows].sum()
        own = gain(g_all, h_all, value(g_all, h_all))
        best = None
        for j, edges in enumerate(self.edges):
            if not len(edges):
                continue
            b = self.bins[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(edges) + 1))[:-1]
            gr, hr = g_all - gl, h_all - hl
            vl, vr = value(gl, hl), value(gr, hr)
            gains = gain(gl, hl, vl) + gain(gr, hr, vr) - own
            allowed = (hl >= LEAST / 4) & (hr >= LEAST / 4) & (self.monotone[j] * (vr - vl) >= 0)
            gains = np.where(allowed, gains, -np.inf)
            k = int(np.argmax(gains))
            if gains[k] > 1e-6 and (best is None or gains[k] > best[0]):
                best = (gains[k], j, k, vl[k], vr[k])
        return best

    def grow(self, at: int, rows, g, h, low: float, high: float, depth: int, margin: np.ndarray) -> None:
        found = self.best_split(rows, g, h, low, high) if depth else None
        if found is None:
            v = float(np.clip(-g[rows].sum() / (h[rows].sum() + L2), low, high)) * RATE
            self.nodes[at] = [-1, 0.0, 0, v]
            margin[rows] += v
            return
        _, j, k, vl, vr = found
        left = len(self.nodes)
        self.nodes[at] = [j, float(self.edges[j][k]), left, 0.0]
        self.nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        middle = (vl + vr) / 2
        # below a constrained split, neither side may cross the middle
        lows, highs = (low, low), (high, high)
        if self.monotone[j] > 0:
            lows, highs = (low, middle), (middle, high)
        elif self.monotone[j] < 0:
            lows, highs = (middle, low), (high, middle)
        goes_left = self.bins[rows, j] <= k
        for side, part in enumerate((rows[goes_left], rows[~goes_left])):
            self.grow(left + side, part, g, h, lows[side], highs[side], depth - 1, margin)


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int]) -> Forest:
    """Trees for labels 0/1. ``monotone[j]``: 1 if the score must not fall with feature j, -1 not rise, 0 free."""
    rate = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    roots: list[int] = []
    grower = Grower(x, monotone) if len(y) and y.min() < y.max() else None
    margin = np.full(len(y), base)
    for _ in range(ROUNDS if grower else 0):
        p = 1.0 / (1.0 + np.exp(-margin))
        roots.append(len(grower.nodes))
        grower.nodes.append([-1, 0.0, 0, 0.0])
        grower.grow(roots[-1], np.arange(len(y)), p - y, p * (1 - p), -10.0, 10.0, DEPTH, margin)
    nodes = np.array(grower.nodes if grower else np.zeros((0, 4)))
    return Forest(
        nodes[:, 0].astype(int), nodes[:, 1], nodes[:, 2].astype(int), nodes[:, 3], np.array(roots, dtype=int), base
    )
