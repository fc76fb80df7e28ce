"""Multiclass, multilabel and hierarchical learners, by reduction to weak regressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.lineage import cut
from millrace.operators.factorization import gradient_factors
from millrace.operators.sampling import poisson
from millrace.plans.models import CodingMatrix, Ensemble, Hierarchy, Join, LabelSets, Model, MultiClass, OneVsRest, Scaled, VectorSum


def gradient(label: Column, cursor: Column, classes: int) -> Column:
    """Antigradient of the log-likelihood of classes - 1 logits with a reference class."""
    p = V.multi_logit(cursor)
    return F.transform(p, lambda v, i: F.when(label == i, 1.0).otherwise(0.0) - v)


@dataclass
class OneVsRestLearner:
    """A binary learner a class, on targets of 1 and -1."""

    make: Callable[[], Any]
    classes: int

    def fit(self, df: DataFrame, label: Column) -> OneVsRest:
        return OneVsRest(Join([self.make().fit(df, F.when(label == c, 1.0).otherwise(-1.0)) for c in range(self.classes)]))


@dataclass
class MultiClassBoosting:
    """Boosting of classes - 1 logits.

    Each step either fits a weak model to every component of the gradient, or
    ("factored") fits one to the gradient's rank-1 factor: with G near h b', the
    model of h is scaled by b.  The factor b comes from G'G, which is one
    aggregation.  "weighted" rows count by 1 / (distance from their factor),
    "filtered" drops the component whose loss leaves the best factorisation,
    "scaled" scales components by Poisson weights.
    """

    weak: Any
    classes: int
    iterations: int = 20
    step: float = 0.3
    mode: str = "factored"
    cut_every: int = 5
    seed: int = 1

    def fit(self, df: DataFrame, label: Column, features: str = "features") -> MultiClass:
        k, rng = self.classes - 1, np.random.default_rng(self.seed)
        now = df.withColumn("_label", label).withColumn("_cursor", F.array(*[F.lit(0.0)] * k))
        models: list[Model] = []
        for i in range(self.iterations):
            now = now.withColumn("_g", gradient(F.col("_label"), F.col("_cursor"), self.classes))
            if self.mode == "scaled":
                scale = rng.poisson(1.0, k).astype(float)
                now = now.withColumn("_g", F.zip_with("_g", V.weights(scale), lambda a, b: a * b))
            if self.mode in ("plain", "scaled"):
                parts = [self.weak.fit(now, F.element_at("_g", c + 1)) for c in range(k)]
                model: Model = Join(parts)
            else:
                b = self._direction(now, k)
                h = V.linear(F.col("_g"), b)
                weight = None
                if self.mode == "weighted":
                    gap = V.total(F.zip_with("_g", F.transform(V.weights(b), lambda v: v * h), lambda a, c: F.abs(a - c)))
                    weight = F.lit(float(k)) / F.greatest(gap, F.lit(1e-3))
                model = Scaled(self.weak.fit(now, h, weight), [float(v) for v in b])
            models.append(model)
            moved = F.zip_with("_cursor", model.column(F.col(features)), lambda a, v: a + self.step * v)
            now = now.withColumn("_cursor", moved).drop("_g")
            if (i + 1) % self.cut_every == 0:
                now = cut(now)
        return MultiClass(VectorSum(models, [self.step] * len(models)))

    def _direction(self, now: DataFrame, k: int) -> np.ndarray:
        g = [F.element_at("_g", i + 1) for i in range(k)]
        row = now.agg(*[F.sum(g[i] * g[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
        gg = np.array([[row[f"g{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)], float)
        if self.mode == "filtered" and k > 1:
            left = []
            for c in range(k):
                rest = np.delete(np.delete(gg, c, 0), c, 1)
                left.append((float(np.trace(rest) - np.linalg.eigvalsh(rest)[-1]), c))
            drop = min(left)[1]
            gg = gg.copy()
            gg[drop, :] = gg[:, drop] = 0.0
        values, vectors = np.linalg.eigh(gg)
        b = vectors[:, -1]
        return b * np.sign(b[np.abs(b).argmax()] or 1.0)


def factored_block(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank-1 factors of a block of gradients, on one machine."""
    return gradient_factors(block)


def coding_matrix(similarity: np.ndarray, columns: int, ridge: float = 0.1, sparse: float = 0.05) -> np.ndarray:
    """Codes of -1, 0, 1 that agree for similar classes, column by column.

    A column is grown greedily from a pair of classes; its cost is -b'Sb plus
    what it shares with earlier columns plus its size.
    """
    k, out = len(similarity), np.zeros((len(similarity), 0))
    for _ in range(columns):
        best = None
        for start in range(k):
            b = np.zeros(k)
            b[start] = 1.0
            cost = np.inf
            while True:
                options = []
                for i in range(k):
                    for v in (-1.0, 0.0, 1.0):
                        if v != b[i]:
                            c = b.copy()
                            c[i] = v
                            if (c > 0).any() and (c < 0).any():
                                shared = ridge * np.abs(out.T @ c).sum() if out.size else 0.0
                                options.append((-c @ similarity @ c / np.abs(c).sum() + shared + sparse * np.abs(c).sum(), tuple(c)))
                now = min(options) if options else None
                if now is None or now[0] >= cost - 1e-12:
                    break
                cost, b = now[0], np.array(now[1])
            if np.isfinite(cost) and (best is None or cost < best[0]):
                best = (cost, b)
        if best is None:
            break
        out = np.column_stack([out, best[1]])
    return out


@dataclass
class CodedLearner:
    """A binary learner a code column; classes with codes near 0 are left out of it."""

    make: Callable[[], Any]
    codes: np.ndarray
    ignore: float = 0.1

    def fit(self, df: DataFrame, label: Column) -> CodingMatrix:
        models = []
        for j in range(self.codes.shape[1]):
            used = {int(i): float(np.sign(c)) for i, c in enumerate(self.codes[:, j]) if abs(c) > self.ignore}
            pairs = F.create_map(*[F.lit(x) for kv in used.items() for x in kv])
            rows = df.withColumn("_code", pairs[label.cast("int")]).where("_code is not null")
            models.append(self.make().fit(rows, F.col("_code")))
        return CodingMatrix(self.codes.tolist(), Join(models), self.ignore)


@dataclass
class HierarchyLearner:
    """A learner a node of a class tree; each sees the rows of its own classes."""

    make: Callable[[], Any]

    def fit(self, df: DataFrame, label: Column, tree: dict) -> Model:
        from millrace.plans.models import Constant

        if "left" not in tree:
            return Constant(float(tree["classes"][0]))
        right = label.isin(tree["right"]["classes"])
        rows = df.where(label.isin(tree["classes"]))
        model = self.make().fit(rows, F.when(right, 1.0).otherwise(-1.0))
        return Hierarchy(_Sign(model), [self.fit(df, label, tree["left"]), self.fit(df, label, tree["right"])])


@dataclass
class _Sign(Model):
    """1 for a positive score, else 0."""

    model: Model

    def column(self, x: Column) -> Column:
        return F.when(self.model.column(x) > 0, 1).otherwise(0)


def powerset(df: DataFrame, labels: str, least: int = 0) -> tuple[DataFrame, list[list[int]]]:
    """`df` with the class of its label vector, and the vectors in order of the first row that has them.

    Vectors with at most `least` rows are dropped, rows and all.
    """
    groups = df.groupBy(labels).agg(F.count("*").alias("n"), F.min("row_id").alias("first")).where(F.col("n") > least)
    sets = [list(r[labels]) for r in groups.orderBy("first").collect()]  # a row a distinct vector
    table = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(sets)], f"{labels} array<int>, class int")
    return df.withColumn(labels, F.col(labels).cast("array<int>")).join(table, labels), sets


@dataclass
class PowersetLearner:
    """A multiclass learner on label vectors."""

    make: Callable[[int], Any]
    least: int = 0

    def fit(self, df: DataFrame, labels: str) -> LabelSets:
        rows, sets = powerset(df, labels, self.least)
        return LabelSets(self.make(len(sets)).fit(rows, F.col("class")), sets)


def conflicts(df: DataFrame, labels: str, empty_class: bool = True) -> DataFrame:
    """A row a positive label as `class`; rows without any are a class of their own, or go."""
    at = F.filter(F.transform(labels, lambda v, i: F.when(v > 0, i)), lambda v: v.isNotNull())
    classes = F.when(F.size(at) > 0, at)
    if empty_class:
        classes = F.coalesce(classes, F.array(F.size(labels)))
    return df.withColumn("class", F.explode(classes))


def bootstrapped(weak: Any, key: str, salt: str = "") -> Any:
    """A weak learner on Poisson bootstrap weights, a new draw each fit."""

    class Wrapped:
        count = 0

        def fit(self, df: DataFrame, y: Column, weight: Column | None = None) -> Model:
            Wrapped.count += 1
            w = poisson(F.col(key), f"{salt}{Wrapped.count}").cast("double")
            return weak.fit(df, y, w if weight is None else w * weight)

    return Wrapped()


def mean_of(models: Sequence[Model]) -> Ensemble:
    """The mean of models."""
    return Ensemble(list(models), [1.0 / len(models)] * len(models))
