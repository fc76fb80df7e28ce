"""Linear learners on sums of products: the rows are read once, the driver solves.

The Gram matrix has features squared numbers, whatever the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.models import Constant, Linear, Model, Single


@dataclass
class Gram:
    """n, sums of products of features, of features and target, and of each alone."""

    n: float
    xx: np.ndarray
    xy: np.ndarray
    x: np.ndarray
    y: float
    yy: float

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Covariances (per row) of features, and of features and target."""
        m = self.x / self.n
        return self.xx / self.n - np.outer(m, m), self.xy / self.n - m * self.y / self.n


def gram(df: DataFrame, features: str, y: Column, width: int, weight: Column | None = None, by: str | None = None) -> dict:
    """Gram sums of all rows (key None), or of each value of `by`; one aggregation."""
    w = F.lit(1.0) if weight is None else weight
    x = [F.element_at(features, i + 1) for i in range(width)]
    rows = df.select(*([by] if by else []), *[v.alias(f"x{i}") for i, v in enumerate(x)], y.alias("_y"), w.alias("_w"))
    c = [F.col(f"x{i}") for i in range(width)]
    sums = [F.sum(F.col("_w") * c[i] * c[j]).alias(f"g{i}_{j}") for i in range(width) for j in range(i + 1)]
    sums += [F.sum(F.col("_w") * c[i] * F.col("_y")).alias(f"xy{i}") for i in range(width)]
    sums += [F.sum(F.col("_w") * c[i]).alias(f"s{i}") for i in range(width)]
    sums += [F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("y"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("yy")]
    found = (rows.groupBy(by) if by else rows.groupBy()).agg(*sums).collect()
    out = {}
    for r in found:
        xx = np.array([[r[f"g{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(width)] for i in range(width)], float)
        out[r[by] if by else None] = Gram(
            float(r.n or 0), xx.reshape(width, width), np.array([r[f"xy{i}"] or 0.0 for i in range(width)], float),
            np.array([r[f"s{i}"] or 0.0 for i in range(width)], float), float(r.y or 0), float(r.yy or 0),
        )
    return out


def coordinate_descent(g: np.ndarray, c: np.ndarray, penalty: float, mix: float, start: np.ndarray | None = None, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Elastic net of mean squares: soft thresholds, one coordinate after the other."""
    w = np.zeros(len(c)) if start is None else start.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(c)):
            rest = c[j] - g[j] @ w + g[j, j] * w[j]
            down = g[j, j] + penalty * (1 - mix)
            new = np.sign(rest) * max(abs(rest) - penalty * mix, 0.0) / down if down > 0 else 0.0
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tolerance:
            break
    return w


@dataclass
class Ridge:
    """(X'X + alpha I)^-1 X'y, no intercept."""

    width: int
    alpha: float = 1.0

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None, features: str = "features") -> Linear:
        s = gram(df, features, y, self.width, weight)[None]
        return Linear(np.linalg.solve(s.xx + self.alpha * np.eye(self.width), s.xy).tolist())


@dataclass
class ValidatedRidge:
    """Ridge with the alpha that does best on held-out rows, refitted on all; 0 if none beats the spread of y."""

    width: int
    alphas: tuple[float, ...] = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)

    def fit(self, df: DataFrame, y: Column, learn: Column, features: str = "features") -> Model:
        parts = gram(df.withColumn("_learn", learn), features, y, self.width, by="_learn")
        a, b = parts.get(True), parts.get(False)
        if a is None or b is None:
            return Constant(0.0)
        best = (b.yy - b.y * b.y / max(b.n, 1.0), None)
        for alpha in self.alphas:
            w = np.linalg.solve(a.xx + alpha * np.eye(self.width), a.xy)
            error = b.yy - 2 * w @ b.xy + w @ b.xx @ w
            if error < best[0]:
                best = (error, alpha)
        if best[1] is None:
            return Constant(0.0)
        return Linear(np.linalg.solve(a.xx + b.xx + best[1] * np.eye(self.width), a.xy + b.xy).tolist())


@dataclass
class ElasticNet:
    """A path of penalties from the largest useful one down, each started from the one before; the mean of y is the intercept."""

    width: int
    penalty: float = 0.01
    mix: float = 0.5
    steps: int = 20

    def path(self, s: Gram) -> list[tuple[float, np.ndarray]]:
        g, c = s.centred()
        top = max(np.abs(c).max() / max(self.mix, 1e-3), self.penalty)
        w, out = np.zeros(self.width), []
        for penalty in np.geomspace(top, max(self.penalty, 1e-12), self.steps):
            w = coordinate_descent(g, c, penalty, self.mix, w)
            out.append((float(penalty), w.copy()))
        return out

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None, features: str = "features") -> Linear:
        s = gram(df, features, y, self.width, weight)[None]
        w = self.path(s)[-1][1]
        return Linear(w.tolist(), float((s.y - w @ s.x) / s.n))


@dataclass
class Stagewise:
    """Small steps along the feature most correlated with the residual."""

    width: int
    steps: int = 1000
    step: float = 0.01

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None, features: str = "features") -> Linear:
        s = gram(df, features, y, self.width, weight)[None]
        w, size = np.zeros(self.width), np.sqrt(np.maximum(np.diag(s.xx), 1e-12))
        for _ in range(self.steps):
            c = (s.xy - s.xx @ w) / size
            j = int(np.abs(c).argmax())
            w[j] += self.step * np.sign(c[j])
        return Linear(w.tolist())


@dataclass
class LeastAngle:
    """Least-angle regression on scaled features, `steps` of its steps."""

    width: int
    steps: int | None = None

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None, features: str = "features") -> Linear:
        s = gram(df, features, y, self.width, weight)[None]
        g, c = s.centred()
        size = np.sqrt(np.maximum(np.diag(g), 1e-12))
        g, c, w = g / np.outer(size, size), c / size, np.zeros(self.width)
        active: list[int] = []
        for _ in range(min(self.steps or self.width, self.width)):
            r = c - g @ w
            outside = [j for j in range(self.width) if j not in active]
            active.append(max(outside, key=lambda j: abs(r[j])))
            top = abs(r[active[0]])
            if top < 1e-12:
                break
            sign = np.sign(r[active])
            direction = np.linalg.lstsq(g[np.ix_(active, active)], sign, rcond=None)[0]
            move = g[:, active] @ direction
            length = top
            for j in range(self.width):
                if j not in active:
                    for a, b in ((top - r[j], 1 - move[j]), (top + r[j], 1 + move[j])):
                        if b > 1e-12 and 1e-12 < a / b < length:
                            length = a / b
            w[active] += length * direction
        w = w / size
        return Linear(w.tolist(), float((s.y - w @ s.x) / s.n))


@dataclass
class BestSingle:
    """Regression on the one feature with the largest |cosine| to the target."""

    width: int

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None, features: str = "features") -> Single:
        s = gram(df, features, y, self.width, weight)[None]
        size = np.sqrt(np.maximum(np.diag(s.xx), 1e-300) * max(s.yy, 1e-300))
        j = int(np.abs(s.xy / size).argmax())
        return Single(j, float(s.xy[j] / s.xx[j, j]) if s.xx[j, j] else 0.0)


def by_task(df: DataFrame, task: str, features: str, y: Column, width: int, alpha: float = 1.0) -> pd.DataFrame:
    """Ridge weights of each task, from one aggregation for all."""
    found = gram(df, features, y, width, by=task)
    rows = [(k, *np.linalg.solve(s.xx + alpha * np.eye(width), s.xy)) for k, s in sorted(found.items())]
    return pd.DataFrame(rows, columns=[task, *[f"w{i}" for i in range(width)]])


def shared_alpha(grams: list[Gram], rounds: int = 30) -> float:
    """One ridge penalty for many tasks by evidence maximisation."""
    alpha = 1.0
    for _ in range(rounds):
        weights = noise = used = rows = 0.0
        for s in grams:
            a = s.xx + alpha * np.eye(len(s.xy))
            w = np.linalg.solve(a, s.xy)
            free = float(np.trace(np.linalg.solve(a, s.xx)))
            weights, used = weights + w @ w, used + free
            noise, rows = noise + max(s.yy - 2 * w @ s.xy + w @ s.xx @ w, 0.0), rows + s.n
        new = used / max(weights, 1e-12) * noise / max(rows - used, 1e-9)
        if abs(new - alpha) < 1e-9 * max(alpha, 1.0):
            break
        alpha = float(new)
    return alpha


@dataclass
class RelevanceVectors:
    """Sparse Bayesian regression by fast marginal likelihood, on the Gram matrix."""

    width: int
    rounds: int = 200

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None, features: str = "features") -> Linear:
        s = gram(df, features, y, self.width, weight)[None]
        g, c = s.xx - np.outer(s.x, s.x) / s.n, s.xy - s.x * s.y / s.n
        spread = s.yy - s.y * s.y / s.n
        noise = max(spread / s.n / 4, 1e-12)
        alpha = np.full(self.width, np.inf)
        mean = np.zeros(self.width)
        for _ in range(self.rounds):
            on = np.flatnonzero(np.isfinite(alpha))
            cover = np.linalg.inv(np.diag(alpha[on]) + g[np.ix_(on, on)] / noise) if len(on) else np.zeros((0, 0))
            gains = []
            for j in range(self.width):
                S = g[j, j] / noise - (g[j, on] @ cover @ g[on, j]) / noise**2
                Q = c[j] / noise - (g[j, on] @ cover @ c[on]) / noise**2
                if np.isfinite(alpha[j]) and abs(alpha[j] - S) > 1e-12:
                    S, Q = alpha[j] * S / (alpha[j] - S), alpha[j] * Q / (alpha[j] - S)
                more = Q * Q - S
                new = S * S / more if more > 0 and S > 0 else np.inf
                old = alpha[j]
                value = (lambda a: 0.5 * (np.log(a / (a + S)) + Q * Q / (a + S)) if np.isfinite(a) else 0.0)  # noqa: B023
                gains.append((value(new) - value(old), j, new))
            gain, j, new = max(gains)
            if gain < 1e-9:
                break
            alpha[j] = new
            on = np.flatnonzero(np.isfinite(alpha))
            mean = np.zeros(self.width)
            if len(on):
                cover = np.linalg.inv(np.diag(alpha[on]) + g[np.ix_(on, on)] / noise)
                mean[on] = cover @ c[on] / noise
                left = spread - 2 * mean @ c + mean @ g @ mean
                noise = max(left / max(s.n - np.sum(1 - alpha[on] * np.diag(cover)), 1.0), 1e-12)
        return Linear(mean.tolist(), float((s.y - mean @ s.x) / s.n))
