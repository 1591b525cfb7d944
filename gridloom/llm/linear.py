"""Hashed n-gram features and small linear models that are fitted on bounded samples."""

from __future__ import annotations

import numpy as np

_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def ngram_counts(codes: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Counts of the n-grams of a byte array, hashed to 2**bits places for each n."""
    out = np.zeros(len(sizes) << bits, np.float32)
    wide = codes.astype(np.uint32)
    for at, n in enumerate(sizes):
        if len(wide) < n:
            continue
        h = np.zeros(len(wide) - n + 1, np.uint32)
        for j in range(n):
            h = (h + wide[j : len(wide) - n + 1 + j] + np.uint32(1)) * _MULTIPLY[j % len(_MULTIPLY)]
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[at << bits : (at + 1) << bits] = np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Square roots of shares, so that the vector has length 1."""
    total = x.sum()
    return np.sqrt(x / total) if total else x


def descend(x: np.ndarray, slope, decay: float, steps: int) -> np.ndarray:  # noqa: ANN001
    """Accelerated gradient descent on a mean loss with quadratic decay; ``slope(scores)`` is the loss's derivative."""
    n, d = x.shape
    w = np.zeros(d, np.float32)
    momentum, rate = w.copy(), 1.0 / (0.25 * 4 * float(np.einsum("ij,ij->i", x, x).max()) + decay)
    for t in range(steps):
        look = w + (t / (t + 3)) * (w - momentum)
        grad = x.T @ slope(x @ look).astype(np.float32) / n + decay * look
        momentum, w = w, look - rate * grad
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-5, steps: int = 300) -> np.ndarray:
    """Logistic regression on soft labels."""
    return descend(x, lambda s: weight * (sigmoid(s) - y), decay, steps)


def machine(x: np.ndarray, sign: np.ndarray, decay: float = 1e-4, steps: int = 150) -> np.ndarray:
    """A linear support vector machine with squared hinge loss; ``sign`` is 1 or -1."""
    part = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    return descend(x, lambda s: -part * sign * np.maximum(0, 1 - sign * s), decay, steps)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
