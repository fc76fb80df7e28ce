"""Numerical optimisers on the driver, for objectives whose sums come from the cluster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Gradient = Callable[[np.ndarray], np.ndarray]
Value = Callable[[np.ndarray], float]


def quadratic(a: np.ndarray, w: np.ndarray, w0: float = 0.0) -> tuple[Value, Gradient]:
    """x'Ax + wx + w0 and its gradient."""
    return (lambda x: float(x @ a @ x + w @ x + w0)), (lambda x: (a + a.T) @ x + w)


def gradient_descent(grad: Gradient, x: np.ndarray, lipschitz: float, rounds: int = 100_000, eps: float = 1e-9) -> np.ndarray:
    """Steps of 1 / L until the gradient is small."""
    for _ in range(rounds):
        g = grad(x)
        if np.linalg.norm(g) < eps:
            break
        x = x - g / lipschitz
    return x


def nesterov(grad: Gradient, x: np.ndarray, lipschitz: float, convexity: float = 0.0, rounds: int = 100_000, eps: float = 1e-9) -> np.ndarray:
    """Accelerated descent; with a convexity constant the momentum is fixed, else it grows."""
    y, t = x, 1.0
    for _ in range(rounds):
        g = grad(y)
        if np.linalg.norm(g) < eps:
            return y
        new = y - g / lipschitz
        if convexity > 0:
            q = np.sqrt(convexity / lipschitz)
            y = new + (1 - q) / (1 + q) * (new - x)
        else:
            up = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, t = new + (t - 1) / up * (new - x), up
        x = new
    return x


def adam(grad: Callable[[np.ndarray, int], np.ndarray], x: np.ndarray, rounds: int, rate: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> np.ndarray:
    """Adam; `grad` may draw a batch by the round."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, rounds + 1):
        g = grad(x, i)
        m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
        x = x - rate * (m / (1 - b1**i)) / (np.sqrt(v / (1 - b2**i)) + eps)
    return x


def flexible(value: Value, grad: Gradient, x: np.ndarray, step: float = 1.0, rounds: int = 10_000, eps: float = 1e-10) -> np.ndarray:
    """The step doubles while the value falls and halves while it rises."""
    now = value(x)
    for _ in range(rounds):
        new = x - step * grad(x)
        after = value(new)
        if after < now:
            if now - after < eps:
                return new
            x, now, step = new, after, step * 2
        else:
            step /= 2
            if step < 1e-18:
                break
    return x


def by_sign(grad: Gradient, x: np.ndarray, step: float = 0.1, rounds: int = 10_000, eps: float = 1e-10) -> np.ndarray:
    """A step a coordinate, doubled while the gradient keeps its sign and halved when it turns."""
    steps, last = np.full(len(x), step), grad(x)
    for _ in range(rounds):
        x = x - steps * np.sign(last)
        g = grad(x)
        steps = np.where(np.sign(g) == np.sign(last), np.minimum(steps * 2, 1e3), steps / 4)
        last = g
        if steps.max() < eps or np.linalg.norm(g) < eps:
            break
    return x


def stochastic(grads: Callable[[np.ndarray, int], np.ndarray], n: int, x: np.ndarray, rounds: int, rate: float, seed: int = 1) -> np.ndarray:
    """Shuffled passes over n parts, the rate falling with passes."""
    rng = np.random.default_rng(seed)
    for i in range(rounds):
        for k in rng.permutation(n):
            x = x - rate / (1 + i) * grads(x, int(k))
    return x


def saga(grads: Callable[[np.ndarray, int], np.ndarray], n: int, x: np.ndarray, rounds: int, rate: float, seed: int = 1) -> np.ndarray:
    """SAGA: a table of the parts' last gradients takes out the variance."""
    rng = np.random.default_rng(seed)
    table = np.array([grads(x, k) for k in range(n)])
    mean = table.mean(axis=0)
    for _ in range(rounds * n):
        k = int(rng.integers(n))
        g = grads(x, k)
        x = x - rate * (g - table[k] + mean)
        mean, table[k] = mean + (g - table[k]) / n, g
    return x


def restarts(fit: Callable[[int], tuple[float, np.ndarray]], n: int) -> np.ndarray:
    """The best of n fits from different seeds."""
    return min((fit(i) for i in range(n)), key=lambda r: r[0])[1]
