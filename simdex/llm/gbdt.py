"""Gradient-boosted trees for binary labels, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray


@dataclass
class BoostedTrees:
    """Complete trees of one depth; node ``i`` has the children ``2i+1`` and ``2i+2``."""

    edges: list[np.ndarray]
    trees: list[Tree]
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, t.feature[node]] > t.cut[node])
            out += t.value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 8) -> BoostedTrees:
    """Newton boosting of the logistic loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)
    n_feat = x.shape[1]
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = BoostedTrees(edges, [], float(np.log(prior / (1 - prior))), depth)
    score = np.full(len(x), model.bias)
    flat = binned + np.arange(n_feat) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.zeros(size, np.int64), np.full(size, bins), np.zeros(size))
        node = np.zeros(len(x), np.int64)
        for i in range(size):
            own = np.flatnonzero(node == i)
            if not len(own):
                continue
            g, h = grad[own].sum(), hess[own].sum()
            if i < 2**depth - 1:
                cols = flat[own].ravel()
                hist = [np.bincount(cols, np.repeat(v[own], n_feat), n_feat * bins).reshape(n_feat, bins).cumsum(axis=1) for v in (grad, hess)]
                count = np.bincount(cols, minlength=n_feat * bins).reshape(n_feat, bins).cumsum(axis=1)
                gl, hl = hist
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                gain[(count < least) | (len(own) - count < least)] = -1
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    tree.feature[i], tree.cut[i] = best // bins, best % bins
                node[own] = 2 * i + 1 + (binned[own, tree.feature[i]] > tree.cut[i])
            else:
                tree.value[i] = -rate * g / (h + l2)
        score += tree.value[node]
        model.trees.append(tree)
    return model


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift that calibrate raw scores on held-out labels, by Newton steps."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w, d = p * (1 - p) + 1e-9, p - target
        g = np.array([(d * raw).sum() + 1e-3 * (a - 1), d.sum()])
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
