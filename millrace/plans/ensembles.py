"""Boosting and bagging over weak learners.

The cursor is a column.  Every few iterations the rows are written to the
checkpoint folder, so that plans stay short and a lost executor costs few
iterations; between those, predictions are expressions of the new trees alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any, Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.losses import TARGETS
from millrace.lineage import cut
from millrace.operators.sampling import poisson
from millrace.plans.models import Ensemble, Model


class Weak(Protocol):
    """What a weak learner has."""

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None) -> Model: ...


@dataclass
class Boosting:
    """Gradient boosting: the cursor starts at 0 and follows the weak model of the loss's steps."""

    weak: Any
    loss: str = "L2"
    iterations: int = 100
    step: float = 0.05
    cut_every: int = 10
    bootstrap_key: str | None = None
    listeners: tuple[Callable[[int, Model, DataFrame], None], ...] = ()

    def fit(self, df: DataFrame, y: Column, features: str = "features") -> Ensemble:
        target = TARGETS[self.loss]
        now = df.withColumn("_y", y).withColumn("_cursor", F.lit(0.0))
        models: list[Model] = []
        for i in range(self.iterations):
            w = poisson(F.col(self.bootstrap_key), f"boost{i}").cast("double") if self.bootstrap_key else None
            model = self.weak.fit(now, target.step(F.col("_y"), F.col("_cursor")), w)
            models.append(model)
            now = now.withColumn("_cursor", F.col("_cursor") + self.step * model.column(F.col(features)))
            if (i + 1) % self.cut_every == 0:
                now = cut(now)
            for listen in self.listeners:
                listen(i, model, now)
        return Ensemble(models, [self.step] * len(models))


def progress(test: DataFrame, y: Column, loss: str, step: float, out: list, every: int = 10, features: str = "features"):
    """A listener that scores `test` each few iterations, adding only the new models to its cursor."""
    state = {"df": test.withColumn("_y", y).withColumn("_cursor", F.lit(0.0))}

    def listen(i: int, model: Model, _: DataFrame) -> None:
        state["df"] = state["df"].withColumn("_cursor", F.col("_cursor") + step * model.column(F.col(features)))
        if (i + 1) % every == 0:
            state["df"] = cut(state["df"])
            out.append((i + 1, state["df"].agg(TARGETS[loss].value(F.col("_y"), F.col("_cursor"))).first()[0]))

    return listen


@dataclass
class Bagging:
    """The mean of weak models on Poisson bootstraps, by the hash of a key."""

    weak: Any
    models: int = 10
    key: str = "row_id"

    def fit(self, df: DataFrame, y: Column) -> Ensemble:
        found = [self.weak.fit(df, y, poisson(F.col(self.key), f"bag{i}").cast("double")) for i in range(self.models)]
        return Ensemble(found, [1.0 / len(found)] * len(found))


def reweighted(df: DataFrame, models: list[Model], y: Column, penalty: float, features: str = "features", rounds: int = 200) -> Ensemble:
    """Lasso weights of given models: their Gram matrix by one aggregation, coordinate descent on the driver."""
    from millrace.plans.linear import coordinate_descent

    p = [m.column(F.col(features)) for m in models]
    sums = [F.sum(p[i] * p[j]).alias(f"g{i}_{j}") for i in range(len(p)) for j in range(i + 1)]
    sums += [F.sum(p[i] * y).alias(f"y{i}") for i in range(len(p))]
    r = df.agg(*sums, F.count("*").alias("n")).first()
    g = np.array([[r[f"g{max(i, j)}_{min(i, j)}"] for j in range(len(p))] for i in range(len(p))], float)
    w = coordinate_descent(g / r.n, np.array([r[f"y{i}"] for i in range(len(p))], float) / r.n, penalty, 1.0, rounds=rounds)
    return Ensemble(models, [float(v) for v in w])


@dataclass
class LassoBoosting:
    """Boosting that gives all models new lasso weights after each step."""

    weak: Any
    iterations: int = 20
    penalty: float = 1e-3

    def fit(self, df: DataFrame, y: Column, features: str = "features") -> Ensemble:
        out = Ensemble([], [])
        rows = df.withColumn("_y", y)
        for _ in range(self.iterations):
            model = self.weak.fit(rows, F.col("_y") - out.column(F.col(features)))
            out = reweighted(rows, [*out.models, model], F.col("_y"), self.penalty, features)
        return out


@dataclass
class AnyOf:
    """A learner chosen by chance, a new one each fit."""

    learners: list
    seed: int = 1

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None) -> Model:
        return self.learners[int(self.rng.integers(len(self.learners)))].fit(df, y, weight)


def support(df: DataFrame, rules: list, features: str = "features") -> dict:
    """Share of rows that meet each compiled rule: one aggregation for all."""
    from millrace.plans.models import above, feature

    x = F.col(features)
    tests = [reduce(lambda a, b: a & b, [above(feature(x, f), b) for f, b in c], F.lit(True)) for c, _ in rules]
    if not tests:
        return {}
    row = df.agg(*[F.avg(F.when(t, 1.0).otherwise(0.0)).alias(f"r{i}") for i, t in enumerate(tests)]).first()
    return {c: row[f"r{i}"] for i, (c, _) in enumerate(rules)}
