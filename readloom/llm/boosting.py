"""Gradient-boosted trees for features with few integer values, fitted to counted cells and rendered as SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Leaf:
    value: float

    def sql(self, row: str) -> str:
        return f"{self.value:.9f}D"

    def of(self, x: dict) -> float:
        return self.value


@dataclass(frozen=True)
class Split:
    feature: str
    most: int
    left: object
    right: object

    def sql(self, row: str) -> str:
        return f"CASE WHEN {row}.{self.feature} <= {self.most} THEN {self.left.sql(row)} ELSE {self.right.sql(row)} END"

    def of(self, x: dict) -> float:
        return (self.left if x[self.feature] <= self.most else self.right).of(x)


@dataclass(frozen=True)
class Boosted:
    start: float
    trees: tuple

    def sql(self, row: str) -> str:
        """Probability of the struct `row`, an SQL expression."""
        total = " + ".join([f"{self.start:.9f}D", *(f"({t.sql(row)})" for t in self.trees)])
        return f"1D / (1D + exp(-({total})))"

    def of(self, x: dict) -> float:
        return 1 / (1 + math.exp(-(self.start + sum(t.of(x) for t in self.trees))))


def _grow(cells: list, features: list[str], depth: int, ridge: float):
    """A tree by Newton gains. cells: (values, gradient, hessian)."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (1e-6, None, None)
    for f in features if depth else ():
        sums: dict[int, list[float]] = {}
        for x, a, b in cells:
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        left_g = left_h = 0.0
        for v in sorted(sums)[:-1]:
            left_g += sums[v][0]
            left_h += sums[v][1]
            gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
            if gain > best[0]:
                best = (gain, f, v)
    if best[1] is None:
        return Leaf(g / (h + ridge))
    _, f, v = best
    return Split(f, v, *(_grow([c for c in cells if (c[0][f] <= v) == side], features, depth - 1, ridge) for side in (True, False)))


def fit(cells: list[tuple[dict, int, int]], features: list[str], rounds: int = 24, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> Boosted:
    """cells: (feature values, positive rows, negative rows). Weighs rows by class, so that both count alike."""
    positive, negative = sum(p for _, p, _ in cells), sum(n for _, _, n in cells)
    if not positive or not negative:
        return Boosted(0.0 if not positive + negative else (4.0 if positive else -4.0), ())
    total = positive + negative
    wp, wn = total / (2 * positive), total / (2 * negative)
    scores, trees = [0.0] * len(cells), []
    for _ in range(rounds):
        graded = []
        for (x, p, n), s in zip(cells, scores):
            q = 1 / (1 + math.exp(-s))
            graded.append((x, p * wp * (1 - q) - n * wn * q, (p * wp + n * wn) * q * (1 - q)))
        tree = _scaled(_grow(graded, features, depth, ridge), rate)
        trees.append(tree)
        scores = [max(-30.0, min(30.0, s + tree.of(x))) for (x, _, _), s in zip(cells, scores)]
    return Boosted(0.0, tuple(trees))


def _scaled(tree, rate: float):
    if isinstance(tree, Leaf):
        return Leaf(tree.value * rate)
    return Split(tree.feature, tree.most, _scaled(tree.left, rate), _scaled(tree.right, rate))


def threshold(model: Boosted, cells: list[tuple[dict, int, int]], precision: float) -> float:
    """A limit such that, over the counted rows of at least that score, `precision` of them are positive; over 1: none. It lies
    halfway to the next lower score; where the precision holds down to the last row, it is one half at most."""
    ranked = sorted(((model.of(x), p, n) for x, p, n in cells), reverse=True, key=lambda c: c[0])
    best, tp, fp = 2.0, 0, 0
    for i, (s, p, n) in enumerate(ranked):
        tp, fp = tp + p, fp + n
        if (i + 1 == len(ranked) or ranked[i + 1][0] < s) and tp and tp >= precision * (tp + fp):
            best = (s + ranked[i + 1][0]) / 2 if i + 1 < len(ranked) else min(s, 0.5)
    return best
