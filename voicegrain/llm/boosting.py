"""Histogram gradient-boosted trees in numpy, and isotonic calibration.

A fitted model is a few small arrays: complete binary trees of one depth, laid out
level by level, so that scoring is ``depth`` gathers for a whole batch of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``feature``, ``limit``: (trees, inner nodes); ``value``: (trees, leaves); a row goes right where x > limit."""

    base: float
    depth: int
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of ``x`` (rows, features)."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - len(limit)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 1.0, l2: float = 1.0) -> Trees:
    """Boosted trees for the labels ``y`` (0 or 1) under logistic loss.

    No rows, or rows of one class, give a model without trees that scores the
    smoothed share of ones.
    """
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    none = Trees(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) == 0 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for col in x.T]
    code = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)  # x <= cuts[code]
    width, nf = bins + 1, x.shape[1]
    flat = code + np.arange(nf) * width
    margin = np.full(len(y), base)
    features, limits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, limit, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, width)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first) * nf * width)[:, None] + flat
            size = count * nf * width
            hg = np.bincount(at.ravel(), np.repeat(g, nf), size).reshape(count, nf, width).cumsum(axis=2)
            hh = np.bincount(at.ravel(), np.repeat(h, nf), size).reshape(count, nf, width).cumsum(axis=2)
            tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
            rg, rh = tg - hg, th - hh
            gain = hg**2 / (hh + l2) + rg**2 / (rh + l2) - tg**2 / (th + l2)
            gain[(hh < least) | (rh < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            won = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            for k in np.flatnonzero(won):
                f, c = divmod(int(best[k]), width)
                feature[first + k], cut[first + k], limit[first + k] = f, c, cuts[f][c]
            node = 2 * node + 1 + (code[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        num, den = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = rate * num / (den + l2)
        margin += value[leaf]
        features.append(feature), limits.append(limit), values.append(value)
    return Trees(base, depth, np.array(features), np.array(limits), np.array(values))


@dataclass
class Isotonic:
    """A non-decreasing map of scores: linear between the points, flat outside."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else score


def isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each pooled block counts one half-row more of either class, so no score is 0 or 1."""
    if len(y) == 0 or y.min() == y.max():
        return Isotonic(np.zeros(0), np.zeros(0))
    values, at = np.unique(score, return_inverse=True)  # rows of one score are one block from the start
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, n, v in zip(values, np.bincount(at), np.bincount(at, y)):
        blocks.append([float(v), float(n), float(s) * float(n)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return Isotonic(b[:, 2] / b[:, 1], np.maximum.accumulate((b[:, 0] + 0.5) / (b[:, 1] + 1)))
