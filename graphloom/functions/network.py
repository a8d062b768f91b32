"""Small numpy helpers used inside pandas functions, and the optimiser step on the driver."""

from __future__ import annotations

import numpy as np

LN_EPS = 1e-9


def glorot(rng: np.random.Generator, rows: int, cols: int) -> np.ndarray:
    edge = np.sqrt(6.0 / (rows + cols))
    return rng.uniform(-edge, edge, (rows, cols))


def stack(series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(float)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def logistic(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -x))


def softmax_rows(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def repeatable_keep(row_hash: np.ndarray, cols: int, rate: float, seed: int) -> np.ndarray:
    """Dropout mask that depends on the row's hash, the column and the seed only."""
    with np.errstate(over="ignore"):
        x = row_hash.astype(np.uint64)[:, None] + np.arange(1, cols + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = x + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    uniform = (x >> np.uint64(11)).astype(float) / float(1 << 53)
    return (uniform >= rate) / (1.0 - rate)


class Adam:
    def __init__(self, lr: float, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8):
        self.lr, self.beta1, self.beta2, self.eps = lr, beta1, beta2, eps
        self.m: dict = {}
        self.v: dict = {}
        self.t = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.t += 1
        out = {}
        for name, p in params.items():
            g = grads[name]
            self.m[name] = self.beta1 * self.m.get(name, 0.0) + (1 - self.beta1) * g
            self.v[name] = self.beta2 * self.v.get(name, 0.0) + (1 - self.beta2) * g * g
            m = self.m[name] / (1 - self.beta1**self.t)
            v = self.v[name] / (1 - self.beta2**self.t)
            out[name] = p - self.lr * m / (np.sqrt(v) + self.eps)
        return out
