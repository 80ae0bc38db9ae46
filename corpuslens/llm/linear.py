"""Logistic regression on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the first is the intercept, not penalised) by Newton steps; ``y`` may hold probabilities."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), l2)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty),
                               x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_sparse(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, l2: float = 1e-6,
               rounds: int = 400, rate: float = 1.0) -> np.ndarray:
    """Weights of hashed features (index 0 is the intercept) by gradient steps with Adagrad scaling."""
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, dtype=np.int64)
    value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    w, seen = np.zeros(dim), np.full(dim, 1e-8)
    for _ in range(rounds):
        p = sigmoid(np.bincount(owner, weights=value * w[index], minlength=len(rows)))
        g = np.bincount(index, weights=value * (p - y)[owner], minlength=dim) / max(len(rows), 1) + l2 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w
