"""Gradient-boosted trees for a binary target, in numpy: trained on binned features, flattened into node arrays, with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Node k of tree t: a row goes to left[t, k] if its feature[t, k] is at most threshold[t, k], else to right[t, k]; leaves lead to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x."""
        rows, out = np.arange(len(x)), np.full(len(x), self.bias)
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int32)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[t][node]] <= self.threshold[t][node], self.left[t][node], self.right[t][node])
            out += self.value[t][node]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, monotone: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, bins: int = 64, least: float = 8.0, sample: float = 1.0
) -> Trees:
    """monotone: for each feature 1 (log-odds never fall with it), -1 (never rise) or 0. least: the least weight of a leaf. sample: the share of
    the rows, drawn anew with a fixed seed, that each tree is grown on.

    A split that breaks a constraint is not made, and the values below a constrained split stay on their side of the midpoint, so the whole
    sum of trees is monotonic.
    """
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    monotone = np.zeros(m, dtype=int) if monotone is None else monotone
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    offset = binned + np.arange(m) * bins
    # A split after a feature's last cut isn't one.
    idle = np.arange(bins - 1)[None, :] >= np.array([len(c) for c in cuts])[:, None]
    share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    bias = float(np.log(share / (1 - share)))
    raw, size = np.full(n, bias), 2 ** (depth + 1) - 1
    shape = (trees, size)
    feature, threshold, value = np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape)
    left, right = (np.tile(np.arange(size, dtype=np.int32), (trees, 1)) for _ in range(2))
    draw = np.random.default_rng(0)
    for t in range(trees):
        p = sigmoid(raw)
        drawn = draw.random(n) < sample
        mass = weight * drawn
        grad, hess = mass * (p - y), mass * p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        best = lambda g, h, k: np.clip(-g / (h + l2), low[k], high[k])
        value[t, 0] = best(grad.sum(), hess.sum(), 0)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            here = np.flatnonzero(drawn & (node >= first) & (node < first + many))
            ids = np.arange(first, first + many)
            cell = ((node[here] - first)[:, None] * (m * bins) + offset[here]).ravel()
            g, h, w = (np.bincount(cell, weights=np.repeat(v[here], m), minlength=many * m * bins).reshape(many, m, bins).cumsum(axis=2) for v in (grad, hess, mass))
            gl, hl, wl = g[:, :, :-1], h[:, :, :-1], w[:, :, :-1]
            gr, hr, wr = g[:, :, -1:] - gl, h[:, :, -1:] - hl, w[:, :, -1:] - wl
            lo, hi = low[ids][:, None, None], high[ids][:, None, None]
            vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
            worth = lambda g, h, v: -(g * v + (h + l2) * v * v / 2)
            won = worth(gl, hl, vl) + worth(gr, hr, vr) - worth(g[:, :, -1], h[:, :, -1], value[t, ids][:, None])[:, :, None]
            won[(wl < least) | (wr < least) | (monotone[:, None] * (vr - vl) < 0) | idle] = -np.inf
            top = won.reshape(many, -1).argmax(axis=1)
            for i in np.flatnonzero(won.reshape(many, -1)[np.arange(many), top] > 1e-9):
                k, (j, c) = first + i, divmod(int(top[i]), bins - 1)
                a, b = 2 * k + 1, 2 * k + 2
                feature[t, k], threshold[t, k], left[t, k], right[t, k] = j, cuts[j][c], a, b
                mine = node == k
                goes = mine & (binned[:, j] <= c)
                low[a], high[a], low[b], high[b] = low[k], high[k], low[k], high[k]
                value[t, a] = best(grad[goes].sum(), hess[goes].sum(), a)
                value[t, b] = best(grad[mine & ~goes].sum(), hess[mine & ~goes].sum(), b)
                if monotone[j]:
                    middle = (value[t, a] + value[t, b]) / 2
                    (high if monotone[j] > 0 else low)[a] = middle
                    (low if monotone[j] > 0 else high)[b] = middle
                node[mine] = b
                node[goes] = a
        value[t] *= rate
        raw += value[t][node]
    return Trees(feature, threshold, left, right, value, bias, depth)
