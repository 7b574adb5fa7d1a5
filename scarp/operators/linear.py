"""Linear models of rows that have or lack each of many features, fitted in one task to the rows of one block.

Objectives and rules are MLlib's: the mean logistic or hinge loss plus half the penalty times the squares of the
coefficients of features scaled to unit deviation, an intercept without penalty, L-BFGS with ten steps of memory, and
its limits of iterations and tolerance. The search along a direction is Breeze's backtracking one for both losses
(MLlib takes it for the hinge loss). No vector as long as the number of features reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Steps that L-BFGS remembers, and values that the last is compared with, as MLlib's.
MEMORY, VALUES = 10, 20
#: Entries that are added up at a time.
STEP = 1 << 20


@dataclass(frozen=True)
class Plan:
    """A linear model to fit to the training rows of a split."""

    turn: int
    kind: str
    most: int
    penalty: float
    tolerance: float = 1e-6


class _Failed(Exception):
    """No step along a direction meets the conditions."""


def _along(f: Callable, x: np.ndarray, d: np.ndarray, value: float, slope: float, alpha: float, shrink: float):
    """A step that meets the strong Wolfe conditions: (alpha, value, gradient)."""
    for _ in range(21):
        got, grad = f(x + alpha * d)
        at = float(grad @ d)
        if got > value + 1e-4 * alpha * slope or not math.isfinite(got):
            times = shrink
        elif at < 0.9 * slope:
            times = 2.1
        elif at > -0.9 * slope:
            times = shrink
        else:
            return alpha, got, grad
        alpha *= times
        if not 1e-10 < alpha < 1e10:
            break
    raise _Failed


def minimised(f: Callable, x: np.ndarray, most: int, tolerance: float) -> np.ndarray:
    """The point that L-BFGS comes to from ``x``; ``f`` gives value and gradient."""
    value, grad = f(x)
    first, values, steps, failed, done = abs(value), [value], [], False, 0
    while done < most and np.linalg.norm(grad) > max(tolerance * abs(value), 1e-8):
        d, parts = -grad, []
        for s, y, sy in reversed(steps):
            parts.append((s @ d) / sy)
            d = d - parts[-1] * y
        if steps:
            s, y, sy = steps[-1]
            d = d * (sy / (y @ y))
        for (s, y, sy), a in zip(steps, reversed(parts)):
            d = d + (a - (y @ d) / sy) * s
        try:
            slope = float(grad @ d)
            if slope >= 0:
                raise _Failed
            alpha, got, new = _along(f, x, d, value, slope, *((1.0, 0.5) if done else (0.5 / np.linalg.norm(grad), 0.1)))
        except _Failed:
            if failed or not steps:
                break
            failed, steps = True, []
            continue
        s, y = alpha * d, new - grad
        if (sy := float(s @ y)) > 0:
            steps = [*steps, (s, y, sy)][-MEMORY:]
        x, value, grad, failed, done = x + s, got, new, False, done + 1
        values = [*values, value][-VALUES:]
        if abs(value - max(values)) <= tolerance * first:
            break
    return x


def logistic(margin: np.ndarray, sign: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the losses, and their derivatives by the margin."""
    m = sign * margin
    small = np.exp(-np.abs(m))
    return float((np.log1p(small) + np.maximum(-m, 0.0)).sum()), -sign * np.where(m >= 0, small, 1.0) / (1.0 + small)


def hinge(margin: np.ndarray, sign: np.ndarray) -> tuple[float, np.ndarray]:
    short = 1.0 - sign * margin
    return float(np.maximum(short, 0.0).sum()), np.where(short > 0, -sign, 0.0)


LOSSES = {"logreg": logistic, "linear_svm": hinge}


def added(to: np.ndarray, size: int, values: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``values[of]`` (or counts) by ``to``, STEP entries at a time, so that no second array as long as the entries is made."""
    out = np.zeros(size)
    for i in range(0, len(to), STEP):
        part = slice(i, i + STEP)
        out += np.bincount(to[part], None if values is None else values[of[part]], size)
    return out


def fitted(block, plan: Plan) -> tuple[np.ndarray, float]:
    """(coefficients of the features of the block, intercept); a feature that all or no training rows have gets 0."""
    loss, train = LOSSES[plan.kind], block.train[plan.turn]
    n, size = int(train.sum()), len(block.features)
    sign = 2.0 * (block.y[train] == 1) - 1.0
    use = train[block.row]
    row, at = (np.cumsum(train, dtype=np.int32) - 1)[block.row[use]], block.at[use]
    del use
    mean = added(at, size) / n
    spread = np.sqrt(np.maximum(mean * (1.0 - mean), 0.0) * n / max(1, n - 1))
    scale = np.divide(1.0, spread, out=np.zeros(size), where=spread > 0)

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x[:-1] * scale
        total, by = loss(added(row, n, w, at) + (x[-1] - w @ mean), sign)
        whole = by.sum()
        grad = np.append((added(at, size, by, row) - whole * mean) * scale / n + plan.penalty * x[:-1], whole / n)
        return total / n + 0.5 * plan.penalty * float(x[:-1] @ x[:-1]), grad

    x = np.zeros(size + 1)
    if plan.kind == "logreg":
        x[-1] = math.log((sign > 0).sum() / (sign < 0).sum())
    x = minimised(f, x, plan.most, plan.tolerance)
    w = x[:-1] * scale
    return w, float(x[-1] - w @ mean)


def probabilities(block, plan: Plan) -> np.ndarray:
    """Of label 1, for every row of the block, by the model fitted to its training rows; both labels must be among them."""
    w, b = fitted(block, plan)
    margin = added(block.row, len(block.key), w, block.at) + b
    return 1.0 / (1.0 + np.exp(-margin))
