"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees of one depth as node arrays: the children of node i are 2i+1 and 2i+2; leaves hold values."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Logistic loss. monotone: +1, -1 or 0 for each feature; a constrained split keeps its two sides in order,
    and the midpoint of the two bounds everything that grows below it."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])  # x <= cuts[b] iff bin <= b
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    inner, margin = 2**depth - 1, np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        value, low, high = np.zeros(2 * inner + 1), np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        node = np.zeros(n, np.int64)
        value[0] = g.sum() / (h.sum() + ridge)
        for i in range(inner):
            value[2 * i + 1] = value[2 * i + 2] = value[i]
            low[[2 * i + 1, 2 * i + 2]], high[[2 * i + 1, 2 * i + 2]] = low[i], high[i]
            mine = np.flatnonzero(node == i)
            if not len(mine):
                continue
            node[mine] = 2 * i + 1
            gs, hs = g[mine], h[mine]
            best = (1e-9, 0, 0, 0.0, 0.0)
            for j in range(k):
                if not len(cuts[j]):
                    continue
                b = binned[j, mine]
                gl = np.cumsum(np.bincount(b, gs, len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hs, len(cuts[j]) + 1))[:-1]
                gr, hr = gs.sum() - gl, hs.sum() - hl
                vl, vr = np.clip(gl / (hl + ridge), low[i], high[i]), np.clip(gr / (hr + ridge), low[i], high[i])
                gain = vl * gl - vl**2 * (hl + ridge) / 2 + vr * gr - vr**2 * (hr + ridge) / 2
                gain -= value[i] * gs.sum() - value[i] ** 2 * (hs.sum() + ridge) / 2
                gain[(hl < least) | (hr < least) | (monotone[j] * (vr - vl) < 0)] = -np.inf
                c = int(np.argmax(gain))
                if gain[c] > best[0]:
                    best = (float(gain[c]), j, c, float(vl[c]), float(vr[c]))
            if best[0] <= 1e-9:
                continue
            _, j, c, vl, vr = best
            feature[i], threshold[i] = j, cuts[j][c]
            value[2 * i + 1], value[2 * i + 2] = vl, vr
            if monotone[j]:
                mid = (vl + vr) / 2
                (high if monotone[j] > 0 else low)[2 * i + 1] = mid
                (low if monotone[j] > 0 else high)[2 * i + 2] = mid
            node[mine] += binned[j, mine] > c
        leaf = rate * value[inner:]
        margin += leaf[node - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)
