"""Small convex fits on bounded samples."""

from __future__ import annotations

import numpy as np


def fit_logistic(
    x: np.ndarray, target: np.ndarray, rows: np.ndarray, ridge: np.ndarray, centre: np.ndarray, rounds: int = 30
) -> np.ndarray:
    """Logistic regression on soft labels of weighted rows, shrunk towards ``centre`` by ``ridge``, by Newton steps."""
    w = centre.astype(np.float64).copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (rows * (p - target)) + ridge * (w - centre)
        curve = (x * (rows * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max()
        w = w - step * min(1.0, 5 / max(1e-9, size))
        if size < 1e-6:
            break
    return w


def isotonic(values: np.ndarray, target: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators on rising ``values``: (centres, means) of the pooled blocks."""
    stack: list[list[float]] = []  # sum of target, sum of value, rows
    for v, t, n in zip(values, target, rows, strict=True):
        stack.append([t * n, v * n, n])
        while len(stack) > 1 and stack[-2][0] * stack[-1][2] >= stack[-1][0] * stack[-2][2]:
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top, strict=True)]
    return np.array([s[1] / s[2] for s in stack]), np.array([s[0] / s[2] for s in stack])
