"""Gradient-boosted trees in numpy: histogram training with monotonic constraints, flat arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class FlatTrees:
    """Perfect binary trees: node i of a tree has the children 2i+1 and 2i+2.

    ``feature`` and ``threshold`` are (trees, inner nodes), ``leaf`` is (trees, leaves).
    A node that was not split has the threshold +inf, so every row goes left.
    """

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.3, reg: float = 1.0) -> FlatTrees:
    """Logistic boosting. ``monotone`` has +1, -1 or 0 for each feature.

    A split on a constrained feature must order the children's values, and the
    middle of both bounds the values of everything below either child. With one
    class only, the model has no trees and scores every row alike.
    """
    inner = 2**depth - 1
    n, m = x.shape
    rate_pos = float(y.mean()) if n else 0.5
    base = float(np.log(max(rate_pos, 1e-6) / max(1 - rate_pos, 1e-6)))
    if n == 0 or rate_pos in (0.0, 1.0):
        return FlatTrees(0.0, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    total = np.full(n, base)
    fs, ts, ls = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(n, dtype=np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for node in range(inner):
            here = np.flatnonzero(at == node)
            best = None
            gs, hs = g[here].sum(), h[here].sum()
            for j in range(m):
                if not len(here) or not len(cuts[j]):
                    continue
                gl = np.cumsum(np.bincount(binned[here, j], g[here], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[here, j], h[here], len(cuts[j]) + 1))[:-1]
                cl = np.cumsum(np.bincount(binned[here, j], minlength=len(cuts[j]) + 1))[:-1]
                vl = np.clip(-gl / (hl + reg), low[node], high[node])
                vr = np.clip(-(gs - gl) / (hs - hl + reg), low[node], high[node])
                gain = gl**2 / (hl + reg) + (gs - gl) ** 2 / (hs - hl + reg) - gs**2 / (hs + reg)
                gain[(cl == 0) | (cl == len(here)) | (monotone[j] * (vr - vl) < 0)] = 0
                k = int(gain.argmax())
                if gain[k] > (best[0] if best else 1e-9):
                    best = (gain[k], j, k, vl[k], vr[k])
            left, right = 2 * node + 1, 2 * node + 2
            low[left], high[left], low[right], high[right] = low[node], high[node], low[node], high[node]
            if best:
                _, j, k, vl, vr = best
                feature[node], threshold[node] = j, cuts[j][k]
                middle = (vl + vr) / 2
                if monotone[j] > 0:
                    high[left], low[right] = middle, middle
                elif monotone[j] < 0:
                    low[left], high[right] = middle, middle
                at[here] = np.where(binned[here, j] > k, right, left)
            else:
                at[here] = left
        for i in range(inner + 1):
            here = at == inner + i
            leaf[i] = rate * np.clip(-g[here].sum() / (h[here].sum() + reg), low[inner + i], high[inner + i])
        total += leaf[at - inner]
        fs.append(feature), ts.append(threshold), ls.append(leaf)
    return FlatTrees(base, depth, np.array(fs), np.array(ts), np.array(ls))
