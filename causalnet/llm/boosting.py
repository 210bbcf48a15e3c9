"""A small gradient-boosted classifier: depth-2 trees on numeric features, logistic loss.

Fitted on the driver from a bounded table, scored as a Column expression of the JVM."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Boosted:
    """trees: (feature, cut, left, right), where a side is a leaf value or (feature, cut, leaf, leaf)."""

    features: tuple[str, ...]
    base: float
    trees: tuple
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows):
            if not isinstance(node, tuple):
                return np.full(len(rows), node)
            f, cut, a, b = node
            low = rows[:, f] <= cut
            return np.where(low, walk(a, rows), walk(b, rows))

        return self.base + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, row: Column) -> Column:
        """The calibrated probability for a struct that holds the features."""

        def walk(node):
            if not isinstance(node, tuple):
                return F.lit(float(node))
            f, cut, a, b = node
            return F.when(row[self.features[f]] <= F.lit(float(cut)), walk(a)).otherwise(walk(b))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + walk(t)
        return 1 / (1 + F.exp(-(total * self.slope + self.shift)))


def fit(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], rounds: int = 30, rate: float = 0.3, leaf: float = 1.0) -> Boosted:
    """Newton boosting with exhaustive cuts; ties take the first feature and the lowest cut."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), base)
    cuts = [np.unique(x[:, j]) for j in range(x.shape[1])]
    cuts = [(c[:-1] + c[1:]) / 2 for c in cuts]
    cuts = [c if len(c) <= 16 else np.unique(np.quantile(c, np.linspace(0.03, 0.97, 16))) for c in cuts]
    low_of = [(x[None, :, j] <= c[:, None]).astype(float) for j, c in enumerate(cuts)]

    def value(g, h):
        return float(rate * g / (h + leaf))

    def split(rows, g, h):
        best = None
        g, h = g[rows], h[rows]
        gs, hs = g.sum(), h.sum()
        for j, low in enumerate(low_of):
            if not len(low):
                continue
            gl, hl = low[:, rows] @ g, low[:, rows] @ h
            gain = gl**2 / (hl + leaf) + (gs - gl) ** 2 / (hs - hl + leaf) - gs**2 / (hs + leaf)
            k = int(np.argmax(gain))
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0] + 1e-12):
                best = (float(gain[k]), j, float(cuts[j][k]))
        return best

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        rows = np.arange(len(y))
        if not (top := split(rows, g, h)):
            break
        sides = []
        for side in (rows[x[:, top[1]] <= top[2]], rows[x[:, top[1]] > top[2]]):
            if b := split(side, g, h):
                low = x[side, b[1]] <= b[2]
                sides.append((b[1], b[2], *(value(g[s].sum(), h[s].sum()) for s in (side[low], side[~low]))))
            else:
                sides.append(value(g[side].sum(), h[side].sum()))
        trees.append((top[1], top[2], *sides))
        margin += Boosted(features, 0.0, (trees[-1],)).margin(x)
    return Boosted(features, base, tuple(trees))


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> Boosted:
    """Platt scaling on rows that the trees have not seen, drawn toward none at all where these are few."""
    m = model.margin(x)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -50, 50)))
        w = p * (1 - p) + 1e-9
        g = np.array([((t - p) * m).sum() - ridge * (a - 1), (t - p).sum() - ridge * b])
        hess = np.array([[(w * m * m).sum() + ridge, (w * m).sum()], [(w * m).sum(), w.sum() + ridge]])
        da, db = np.linalg.solve(hess, g)
        a, b = a + da, b + db
    return Boosted(model.features, model.base, model.trees, float(a), float(b))
