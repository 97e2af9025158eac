"""Boosted regression trees for a bounded table of numbers: logistic loss, histogram splits, calibrated scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Tree = list[tuple[int, float, int, int, float]]  # feature (-1: leaf), threshold, left (<=), right, value


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int) -> Tree:
    tree: Tree = []

    def node(rows: np.ndarray, left: int) -> int:
        at = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree.append((-1, 0.0, 0, 0, total_g / (total_h + 1.0)))
        best = (1e-6, -1, 0)
        if left and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = bins[rows, f]
                sums = [np.bincount(b, w, len(c) + 1).cumsum()[:-1] for w in (g[rows], h[rows], None)]
                fits = (sums[2] >= least) & (len(rows) - sums[2] >= least)
                gain = sums[0] ** 2 / (sums[1] + 1) + (total_g - sums[0]) ** 2 / (total_h - sums[1] + 1) - total_g ** 2 / (total_h + 1)
                gain = np.where(fits, gain, -np.inf)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], f, i)
        if best[1] >= 0:
            _, f, i = best
            low = bins[rows, f] <= i
            a, b = node(rows[low], left - 1), node(rows[~low], left - 1)
            tree[at] = (f, float(cuts[f][i]), a, b, 0.0)
        return at

    node(np.arange(len(x)), depth)
    return tree


@dataclass
class Boosted:
    """Trees, and the line that turns their sum into a probability."""

    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            f, t, a, b, v = (np.array(c) for c in zip(*tree))
            while (inner := f[at] >= 0).any():
                low = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
                at = np.where(inner, np.where(low, a[at], b[at]), at)
            out += v[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.shift) if len(x) else np.zeros(0)


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, least: int = 8, bins: int = 32) -> Boosted:
    """Fit on two thirds of the rows, calibrate by logistic regression of the sum on the rest."""
    fold = np.arange(len(y)) % 3 == 2
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] if len(x) else c for f, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    grow = np.flatnonzero(~fold)
    share = np.clip(y[grow].mean(), 1e-3, 1 - 1e-3)
    model = Boosted(base=float(np.log(share / (1 - share))))
    score = np.full(len(grow), model.base)
    for _ in range(rounds):
        p = _sigmoid(score)
        tree = _grow(x[grow], codes[grow], cuts, y[grow] - p, p * (1 - p), depth, least)
        tree = [(f, t, a, b, v * rate) for f, t, a, b, v in tree]
        model.trees.append(tree)
        score += Boosted([tree]).raw(x[grow])
    held, target = model.raw(x[fold]), y[fold].astype(float)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps, damped towards slope 1
        p = _sigmoid(slope * held + shift)
        w = p * (1 - p)
        grad = np.array([((target - p) * held).sum() - 1e-2 * (slope - 1), (target - p).sum() - 1e-2 * shift])
        hess = np.array([[(w * held * held).sum() + 1e-2, (w * held).sum()], [(w * held).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        slope, shift = slope + np.clip(step[0], -1, 1), shift + np.clip(step[1], -1, 1)
    model.slope, model.shift = float(slope), float(shift)
    return model


def cut_for_precision(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Least probability at and above which the share of true rows is at least ``precision``; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(p[order][1:] != p[order][:-1], True) if len(p) else np.zeros(0, bool)
    good = np.flatnonzero((share >= precision) & ends)
    return float(p[order][good[-1]]) if len(good) else 1.1
