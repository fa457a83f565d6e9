"""A small logistic regression on sparse features for bounded training sets (numpy only)."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_sparse(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, target: np.ndarray, weight: np.ndarray, dims: int, l2: float = 1e-4, rounds: int = 200, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise weighted log loss; ``target`` may hold probabilities.

    Full-batch Adam, so equal inputs give equal models. Without rows the model is constant 0.5.
    """
    w, b = np.zeros(dims), 0.0
    n = len(target)
    total = weight.sum()
    if n == 0 or total <= 0:
        return w, b
    share = float(np.clip((weight * target).sum() / total, 1e-3, 1 - 1e-3))
    b = float(np.log(share / (1 - share)))
    used = np.unique(cols)
    at = np.searchsorted(used, cols)
    v, m1, m2, mb1, mb2 = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(rows, vals * v[at], n) + b
        g = (sigmoid(z) - target) * weight / total
        gw = np.bincount(at, vals * g[rows], len(used)) + l2 * v
        gb = g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.999 * mb2 + 0.001 * gb * gb
        step = rate / (1 - 0.9**t)
        v -= step * m1 / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        b -= step * mb1 / (np.sqrt(mb2 / (1 - 0.999**t)) + 1e-8)
    w[used] = v
    return w, float(b)


def fit_dense(x: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    rows, cols = np.indices(x.shape)
    return fit_sparse(rows.ravel(), cols.ravel(), x.ravel(), target, weight, x.shape[1], l2, rounds)
