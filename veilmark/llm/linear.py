"""Sparse linear models trained by follow-the-regularised-leader with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Multinomial logistic regression over sparse rows (indices, values); one pass updates one row at a time."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1) -> None:
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, seed: int) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, x = rows[i]
                w = self.weights(at)
                g = x[:, None] * softmax(x @ w)[None, :]
                g[:, labels[i]] -= x
                n = self.n[at]
                grown = n + g * g
                self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
                self.n[at] = grown
        return self


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the weights were not fitted to."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
