"""Linear support vector machines by dual coordinate descent, and probabilities from margins."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, size: int, cost: np.ndarray, epochs: int = 40, seed: int = 7, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of a hinge-loss model with L2 penalty.

    ``rows`` and ``values`` are each example's features; ``cost`` its bound on the dual variable.
    """
    weights, dual = np.zeros(size + 1), np.zeros(len(rows))
    squares = np.array([float(v @ v) + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for k in random.permutation(len(rows)):
            row, value = rows[k], values[k]
            gradient = signs[k] * (weights[row] @ value + weights[-1]) - 1.0
            new = min(max(dual[k] - gradient / squares[k], 0.0), cost[k])
            step = (new - dual[k]) * signs[k]
            if step:
                weights[row] += step * value
                weights[-1] += step
                dual[k] = new
                most = max(most, abs(step) * squares[k])
        if most < tolerance:
            break
    return weights


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins, whatever their scale, into probabilities (regularised
    Newton steps on the centred and scaled margins)."""
    middle, scale = float(margins.mean()), float(margins.std()) or 1.0
    margins = (margins - middle) / scale
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        w, d = p * (1 - p) + 1e-9, p - target
        g = np.array([(d * margins).sum() + 1e-3 * slope, d.sum()])
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        change = np.linalg.solve(h, g)
        slope, offset = slope - np.clip(change[0], -2, 2), offset - np.clip(change[1], -2, 2)
        if abs(change).max() < 1e-8:
            break
    slope = max(float(slope), 1e-3) / scale
    return slope, float(offset) - slope * middle


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
