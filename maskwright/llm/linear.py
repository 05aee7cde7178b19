"""Logistic regression on sparse rows, for fits on bounded samples."""

from __future__ import annotations

import numpy as np


def fit_logistic(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, weight: np.ndarray, width: int, ridge: float = 1e-4, rounds: int = 200, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept by full gradients with adaptive steps; targets may be soft."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    index = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    value = np.concatenate(values) if len(rows) else np.zeros(0)
    row = np.repeat(np.arange(len(rows)), sizes)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    weight = weight / weight.sum()
    for step in range(1, rounds + 1):
        z = np.bincount(row, value * w[index], len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight
        slope = np.append(np.bincount(index, value * error[row], width), error.sum())
        slope[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])
