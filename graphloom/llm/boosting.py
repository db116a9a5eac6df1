"""Boosted trees of depth two over a table of counts, as a column expression.

The rows are combinations of small integer features with their counts of positives and negatives: the table's size is bounded by the
features' ranges whatever the input, so it is fitted on the driver; scoring is a DataFrame expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A row: features, positives, negatives.
Row = tuple[tuple[int, ...], float, float]


@dataclass(frozen=True)
class Split:
    """Rows whose feature is at most cut go left; a leaf is a number."""

    feature: int
    cut: int
    left: Split | float
    right: Split | float


def _leaf(rows, l2: float) -> float:
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    return g / (h + l2)


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int, l2: float) -> Split | float:
    """rows: features, gradient, hessian sums. The split of largest gain, or a leaf."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-9, None, None)
    for f in range(len(rows[0][0]) if depth else 0):
        sums: dict[int, list[float]] = {}
        for r in rows:
            s = sums.setdefault(r[0][f], [0.0, 0.0])
            s[0] += r[1]
            s[1] += r[2]
        lg = lh = 0.0
        for v in sorted(sums)[:-1]:
            lg, lh = lg + sums[v][0], lh + sums[v][1]
            gain = lg * lg / (lh + l2) + (g - lg) ** 2 / (h - lh + l2) - g * g / (h + l2)
            if gain > best[0]:
                best = (gain, f, v)
    if best[1] is None:
        return _leaf(rows, l2)
    _, f, v = best
    return Split(f, v, _grow([r for r in rows if r[0][f] <= v], depth - 1, l2), _grow([r for r in rows if r[0][f] > v], depth - 1, l2))


def value(tree: Split | float, x: tuple[int, ...]) -> float:
    while isinstance(tree, Split):
        tree = tree.left if x[tree.feature] <= tree.cut else tree.right
    return tree


def fit(rows: list[Row], trees: int = 16, depth: int = 2, rate: float = 0.4, l2: float = 1.0) -> list[Split | float]:
    """Logistic loss by Newton steps. The first tree is the base rate's log odds."""
    pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
    model: list[Split | float] = [math.log((pos + 1) / (neg + 1))]
    margin = [model[0]] * len(rows)
    for _ in range(trees if rows else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        model.append(_scaled(_grow([(r[0], r[1] * (1 - q) - r[2] * q, (r[1] + r[2]) * q * (1 - q)) for r, q in zip(rows, p, strict=True)], depth, l2), rate))
        margin = [m + value(model[-1], r[0]) for m, r in zip(margin, rows, strict=True)]
    return model


def _scaled(tree: Split | float, rate: float) -> Split | float:
    return Split(tree.feature, tree.cut, _scaled(tree.left, rate), _scaled(tree.right, rate)) if isinstance(tree, Split) else tree * rate


def margin(model: list[Split | float], x: tuple[int, ...]) -> float:
    return sum(value(t, x) for t in model)


def column(model: list[Split | float], features: list[Column]) -> Column:
    def one(tree: Split | float) -> Column:
        if isinstance(tree, Split):
            return F.when(features[tree.feature] <= tree.cut, one(tree.left)).otherwise(one(tree.right))
        return F.lit(float(tree))

    return reduce(lambda a, b: a + b, map(one, model))


def threshold(scored: list[tuple[float, float, float]], precision: float) -> float:
    """scored: margin, positives, negatives of held-out rows. The least margin above which the precision, by its lower confidence bound, is as asked; infinity if none is."""
    cut, pos, neg = math.inf, 0.0, 0.0
    scored = sorted(scored, reverse=True)
    for k, (m, p, n) in enumerate(scored):
        pos, neg = pos + p, neg + n
        if k + 1 < len(scored) and scored[k + 1][0] == m:
            continue
        total = pos + neg
        share, z = pos / total if total else 0.0, 1.64
        lower = (share + z * z / (2 * total) - z * math.sqrt(share * (1 - share) / total + z * z / (4 * total * total))) / (1 + z * z / total) if total else 0.0
        if lower >= precision:
            cut = m
    return cut


def calibrated(model: list[Split | float], held: list[Row], precision: float) -> float:
    """The threshold for one model and held-out rows."""
    return threshold([(margin(model, r[0]), r[1], r[2]) for r in held], precision)
