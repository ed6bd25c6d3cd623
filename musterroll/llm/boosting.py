"""Gradient-boosted trees over a table of counted feature cells.

Features are small integers, so all rows that agree in them are one weighted cell: the
fit sees every candidate of the corpus through a table whose size the features bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    """``feature < at`` goes to ``left``; leaves are floats."""

    feature: int
    at: int
    left: Split | float
    right: Split | float


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: list[Split | float]

    def margin(self, cells: np.ndarray) -> np.ndarray:
        total = np.full(len(cells), self.start)
        for tree in self.trees:
            total += _follow(tree, cells)
        return total

    def probability(self, cells: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(cells)))

    def column(self, features: list[Column]) -> Column:
        """The probability as a column expression over the feature columns."""
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + _column(tree, features)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _follow(node: Split | float, cells: np.ndarray) -> np.ndarray:
    if not isinstance(node, Split):
        return np.full(len(cells), node)
    return np.where(cells[:, node.feature] < node.at, _follow(node.left, cells), _follow(node.right, cells))


def _column(node: Split | float, features: list[Column]) -> Column:
    if not isinstance(node, Split):
        return F.lit(float(node))
    test = features[node.feature] < node.at
    return F.when(test, _column(node.left, features)).otherwise(_column(node.right, features))


def _grow(cells, gradient, curvature, depth: int, l2: float, rate: float) -> Split | float:
    def gain(g, h):
        return g * g / (h + l2)

    total_g, total_h = gradient.sum(), curvature.sum()
    best = (1e-6, None, None)
    if depth:
        for feature in range(cells.shape[1]):
            for at in np.unique(cells[:, feature])[1:]:
                low = cells[:, feature] < at
                g, h = gradient[low].sum(), curvature[low].sum()
                won = gain(g, h) + gain(total_g - g, total_h - h) - gain(total_g, total_h)
                if won > best[0]:
                    best = (won, feature, int(at))
    if best[1] is None:
        return float(rate * total_g / (total_h + l2))
    low = cells[:, best[1]] < best[2]
    sides = [_grow(cells[s], gradient[s], curvature[s], depth - 1, l2, rate) for s in (low, ~low)]
    return Split(best[1], best[2], *sides)


def boost(
    cells: np.ndarray, positive: np.ndarray, total: np.ndarray, n_trees: int = 20, depth: int = 3,
    rate: float = 0.4, l2: float = 1.0,
) -> Boosted:
    """Newton boosting on the log loss; ``positive`` of the ``total`` rows of a cell are true."""
    share = (positive.sum() + 1) / (total.sum() + 2)
    model = Boosted(float(np.log(share / (1 - share))), [])
    margin = model.margin(cells)
    for _ in range(n_trees if len(cells) else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(cells, positive - total * p, total * p * (1 - p), depth, l2, rate)
        model.trees.append(tree)
        margin = margin + _follow(tree, cells)
    return model


def threshold_for(probability: np.ndarray, positive: np.ndarray, total: np.ndarray, precision: float) -> float:
    """The lowest probability from which on the selected rows reach ``precision``.

    Above one (nothing is selected) if no cell reaches it.
    """
    order = np.argsort(-probability, kind="stable")
    right, all_ = np.cumsum(positive[order]), np.cumsum(total[order])
    last = np.append(np.diff(probability[order]) != 0, True) if len(order) else np.zeros(0, bool)
    good = np.flatnonzero(last & (all_ > 0) & (right >= precision * all_))
    return float(probability[order][good[-1]]) if len(good) else 1.5
