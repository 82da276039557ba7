"""Histogram decision trees: gradient-boosted and as a random forest, small enough to read.

Features are cut into at most BINS bins at quantiles of the sample; a level of a tree is grown at once from
histograms of gradients by node, feature and bin.  A model is a handful of arrays (feature, threshold, children, value
of all nodes of all trees), and scoring moves all rows of a batch down a tree level by level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Model:
    base: float = 0.0
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)  # -1 in leaves
    threshold: list[float] = field(default_factory=list)  # a row goes left if its value is at most this
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def node(self) -> int:
        for column, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def total(self, x: np.ndarray) -> np.ndarray:
        """Base and the trees' values, by row."""
        feature, threshold, left, right, value = map(np.array, (self.feature, self.threshold, self.left, self.right, self.value))
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := feature[at] >= 0).any():
                f = feature[at]
                at = np.where(inner, np.where(x[rows, np.maximum(f, 0)] <= threshold[at], left[at], right[at]), at)
            out += value[at]
        return out


class Bins:
    def __init__(self, x: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.x = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T, strict=True)], axis=1)


def grow(model: Model, bins: Bins, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, ridge: float, least: float, use: np.ndarray | None = None) -> np.ndarray:
    """Adds a tree whose leaves have rate * sum(grad) / (sum(hess) + ridge); gives each row's value. use: 1 for the features that the tree may take."""
    x, n_features = bins.x, bins.x.shape[1]
    root = model.node()
    model.roots.append(root)
    at, level = np.full(len(x), root), [root]
    for d in range(depth + 1):
        inside = at >= level[0]
        slot = at[inside] - level[0]
        g, h = np.bincount(slot, grad[inside], len(level)), np.bincount(slot, hess[inside], len(level))
        for i, k in enumerate(level):
            model.value[k] = float(rate * g[i] / (h[i] + ridge))
        if d == depth:
            break
        shape = (len(level), n_features, BINS)
        key = ((slot[:, None] * n_features + np.arange(n_features)) * BINS + x[inside]).reshape(-1)
        gl, hl = (np.bincount(key, np.repeat(v[inside], n_features), int(np.prod(shape))).reshape(shape).cumsum(axis=2) for v in (grad, hess))
        gr, hr = g[:, None, None] - gl, h[:, None, None] - hl
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g**2 / (h + ridge))[:, None, None]
        gain[(hl < least) | (hr < least)] = 0
        if use is not None:
            gain *= use[None, :, None]
        best = gain.reshape(len(level), -1).argmax(axis=1)
        grown: list[int] = []
        for i, k in enumerate(level):
            f, b = divmod(int(best[i]), BINS)
            if gain[i, f, b] <= 1e-9 or b >= len(bins.cuts[f]):
                continue
            left, right = model.node(), model.node()
            model.feature[k], model.threshold[k], model.left[k], model.right[k] = f, float(bins.cuts[f][b]), left, right
            mine = at == k
            at[mine] = np.where(x[mine, f] <= b, left, right)
            grown += [left, right]
        if not grown:
            break
        level = grown
    return np.array(model.value)[at]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15) -> Model:
    """Logistic boosting: sigmoid(total(x)) is the probability.  One class alone, or no rows, gives a constant."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(base=float(np.log(p / (1 - p))))
    if 0 < y.sum() < len(y):
        bins, margin = Bins(x), np.full(len(y), model.base)
        for _ in range(trees):
            p = sigmoid(margin)
            margin += grow(model, bins, y - p, p * (1 - p), depth, rate, 1.0, 1.0)
    return model


def forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 6, seed: int = 7) -> Model:
    """Random forest: total(x) is the mean share of ones in the leaves.  Each tree has its own rows, drawn with repeats, and features."""
    model, draw = Model(), np.random.default_rng(seed)
    if not len(y):
        return Model(base=0.5)
    bins = Bins(x)
    for _ in range(trees):
        times = np.bincount(draw.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        features = np.zeros(x.shape[1])
        features[draw.permutation(x.shape[1])[: max(2, (2 * x.shape[1]) // 3)]] = 1
        grow(model, bins, times * y, times, depth, 1 / trees, 1e-9, 1.0, features)
    return model
