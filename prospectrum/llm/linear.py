"""Small linear models trained on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by dual coordinate descent. y: -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float32)
    rng, alpha, w = np.random.default_rng(seed), np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    # Classes of unequal size weigh alike.
    each = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    half = 0.5 / each
    norm = (x * x).sum(axis=1) + half
    for _ in range(rounds):
        for i in rng.permutation(len(x)).tolist():
            g = y[i] * float(w @ x[i]) - 1 + half[i] * alpha[i]
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


def margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.3, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic regression, by Newton's method. y: 0 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    weight = np.ones(len(x)) if weight is None else weight
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))  # far steps overshoot where classes separate
        if np.abs(step).max() < 1e-6:
            break
    return w
