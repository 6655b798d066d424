"""Hashed character n-grams and a follow-the-regularised-leader classifier, as small numpy kernels for Spark tasks."""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed_ngrams(points: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket (0 to 2**bits - 1) of every n-gram of the given orders, position by position."""
    out = []
    for n in orders:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint32) * _C
        for i in range(n):
            h = (h ^ points[i : len(points) - n + 1 + i]) * _A
            h ^= h >> np.uint32(15)
        h *= _B
        out.append(h >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression by per-coordinate follow-the-regularised-leader with L1 and L2 penalties.

    ``z`` and ``n`` have one row per feature and one column per class. A weight is exactly zero while |z| <= l1, so the
    model is sparse.
    """

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        """One example: distinct feature rows with their values and the class."""
        w = self.weights(rows)
        error = softmax(values @ w)
        error[label] -= 1.0
        g = values[:, None] * error[None, :]
        n = self.n[rows]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[rows] += g - sigma * w
        self.n[rows] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the lowest log loss, by golden section on its logarithm; 1 without examples."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = loss(a), loss(b)
    for _ in range(40):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = loss(b)
    return float(np.exp((lo + hi) / 2))
