"""Greedy oblivious trees and regions on binned rows.

Rows carry `bins`.  A level is one aggregation: (leaf, feature, bin) sums, made
before the shuffle, so that what moves and what the driver sees grow with bins
and leaves and never with rows.  Leaves are expressions of the bins and the
conditions taken so far: no level rewrites the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.losses import CRITERIA, Criterion
from millrace.operators.aggregates import histogram
from millrace.operators.grid import Grid
from millrace.plans.models import Bumpy, Cnf, Linear, ObliviousTree, Region


def leaf_of(bins: Column, taken: Sequence[tuple[int, int]]) -> Column:
    """Leaf from (feature, bin) conditions, first one highest: is the row's bin above?"""
    n = len(taken)
    bits = [F.when(F.element_at(bins, f + 1) > b, 1 << n - 1 - k).otherwise(0) for k, (f, b) in enumerate(taken)]
    return reduce(lambda a, b: a + b, bits, F.lit(0))


def _tables(hist: DataFrame, leaves: int, grid: Grid) -> np.ndarray:
    """Histogram as an array [leaf, feature, bin, (n, s, s2)]."""
    width = max((len(r) for r in grid.borders), default=0) + 1
    out = np.zeros((leaves, len(grid.borders), width, 3))
    for r in hist.collect():  # leaves x features x bins numbers
        out[r.leaf, r.feature, r.bin] = r.n, r.s, r.s2
    return out


def _score(table: np.ndarray, score) -> np.ndarray:
    """A criterion of an array of (n, s, s2)."""
    flat = table.reshape(-1, 3)
    return np.array([score(float(n), float(s), float(s2)) for n, s, s2 in flat]).reshape(table.shape[:-1])


@dataclass
class ObliviousTreeLearner:
    """One condition a level: the one with the least sum of the leaves' scores; stops when none improves.

    `known_penalty` > 0 charges conditions that no earlier tree has used with
    that share of the score.  `linear_leaves` fits a ridge model on the tree's
    features in each leaf.
    """

    grid: Grid
    depth: int = 6
    criterion: str = "SatL2"
    known_penalty: float = 0.0
    linear_leaves: bool = False
    ridge: float = 1.0
    known: set = field(default_factory=set)

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None, bins: str = "bins", features: str = "features") -> ObliviousTree:
        c: Criterion = CRITERIA[self.criterion]
        taken: list[tuple[int, int]] = []
        w = F.lit(1.0) if weight is None else weight
        rows = df.select(bins, features, y.alias("_t"), w.alias("_weight")) if features in df.columns else df.select(bins, y.alias("_t"), w.alias("_weight"))
        best, stats = np.inf, None
        for _ in range(self.depth + 1):
            leafed = rows.withColumn("leaf", leaf_of(F.col(bins), taken))
            hist = histogram(leafed, bins, F.col("_t"), F.col("_weight"), by=["leaf"])
            table = _tables(hist, 1 << len(taken), self.grid)
            stats = table[:, 0].sum(axis=1) if table.shape[1] else np.zeros((1 << len(taken), 3))
            if len(taken) == self.depth or not table.shape[1]:
                break
            left = table.cumsum(axis=2)
            right = left[:, :, -1:, :] - left
            score = (_score(left, c.score) + _score(right, c.score)).sum(axis=0)
            for f, row in enumerate(self.grid.borders):
                score[f, len(row):] = np.inf
                for b in range(len(row)):
                    if (f, b) in taken:
                        score[f, b] = np.inf
                    elif self.known_penalty and (f, b) not in self.known:
                        score[f, b] += self.known_penalty * abs(score[f, b])
            now = float(score.min())
            if not now < best - 1e-9 * max(1.0, abs(now)) and taken or not np.isfinite(now):
                break
            best = now
            f, b = divmod(int(score.argmin()), score.shape[1])
            taken.append((f, b))
            self.known.add((f, b))
        conditions = [(f, self.grid.borders[f][b]) for f, b in taken]
        tree = ObliviousTree(conditions, [float(c.leaf(float(n), float(s))) for n, s, _ in stats], [float(n) for n, _, _ in stats])
        if self.linear_leaves and taken:
            tree = self._linear(rows, tree, taken, bins, features)
        return tree

    def _linear(self, rows: DataFrame, tree: ObliviousTree, taken: list[tuple[int, int]], bins: str, features: str) -> ObliviousTree:
        used = sorted({f for f, _ in taken})
        x = [F.lit(1.0), *[F.element_at(features, f + 1) for f in used]]
        leafed = rows.withColumn("leaf", leaf_of(F.col(bins), taken))
        sums = [F.sum(F.col("_weight") * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(len(x)) for j in range(i + 1)]
        sums += [F.sum(F.col("_weight") * x[i] * F.col("_t")).alias(f"y{i}") for i in range(len(x))]
        width = max(used) + 1
        models = [Linear([0.0] * width, 0.0) for _ in range(1 << len(taken))]
        for r in leafed.groupBy("leaf").agg(*sums).collect():  # a row a leaf
            g = np.array([[r[f"g{max(i, j)}_{min(i, j)}"] for j in range(len(x))] for i in range(len(x))], float)
            w = np.linalg.solve(g + self.ridge * np.eye(len(x)), np.array([r[f"y{i}"] for i in range(len(x))], float))
            weights = [0.0] * width
            for f, v in zip(used, w[1:]):
                weights[f] = float(v)
            models[r.leaf] = Linear(weights, float(w[0]))
        return ObliviousTree(tree.conditions, [], tree.weights, models)


def binned(df: DataFrame, grid: Grid, features: str = "features", bins: str = "bins") -> DataFrame:
    """`df` with the bins of its features."""
    return df.withColumn(bins, grid.bins(F.col(features)))


def _inside_stats(rows: DataFrame, inside: Column, bins: str, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Histogram of the rows inside, and of all rows."""
    hist = histogram(rows.withColumn("leaf", F.when(inside, 1).otherwise(0)), bins, F.col("_t"), F.col("_weight"), by=["leaf"])
    table = _tables(hist, 2, grid)
    return table[1], table[0] + table[1]


@dataclass
class RegionLearner:
    """A conjunction of one-sided conditions, grown while the score of inside and outside falls.

    With `failures` > 0 that many conditions may fail.  `nested` instead gives
    increments along the conditions (a bumpy region).
    """

    grid: Grid
    depth: int = 6
    criterion: str = "L2GreedyTDRegion"
    failures: int = 0
    nested: bool = False
    least: float = 4.0

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None, bins: str = "bins") -> Region | Bumpy:
        score = CRITERIA[self.criterion].score
        rows = df.select(bins, y.alias("_t"), (F.lit(1.0) if weight is None else weight).alias("_weight"))
        taken: list[tuple[int, int, bool]] = []
        values: list[float] = []
        best, inside_stat, all_stat = np.inf, None, None
        for _ in range(self.depth + 1):
            inside = _holds(F.col(bins), taken, 0)
            table, everything = _inside_stats(rows, inside, bins, self.grid)
            inside_stat, all_stat = table[0].sum(axis=0), everything[0].sum(axis=0)
            if taken:
                values.append(float(inside_stat[1] / max(inside_stat[0], 1e-9)))
            if len(taken) == self.depth:
                break
            low = table.cumsum(axis=1)
            high = low[:, -1:, :] - low
            options = []
            for f, row in enumerate(self.grid.borders):
                for b in range(len(row)):
                    for up, part in ((True, high[f, b]), (False, low[f, b])):
                        if part[0] >= self.least and all_stat[0] - part[0] >= self.least and (f, b, up) not in taken:
                            rest = all_stat - part
                            options.append((score(*map(float, part)) + score(*map(float, rest)), f, b, up))
            if not options:
                break
            now, f, b, up = min(options)
            if now >= best - 1e-12:
                break
            best = now
            taken.append((f, b, up))
        conditions = [(f, self.grid.borders[f][b], up) for f, b, up in taken]
        base = float(all_stat[1] / max(all_stat[0], 1e-9))
        if self.nested:
            steps = [v - w for v, w in zip(values, [base, *values[:-1]])]
            return Bumpy(conditions, steps[: len(conditions)], base)
        if self.failures:
            inside = _holds(F.col(bins), taken, self.failures)
            r = rows.groupBy(inside.alias("i")).agg(F.sum("_weight").alias("n"), F.sum(F.col("_weight") * F.col("_t")).alias("s")).collect()
            mean = {x.i: x.s / x.n for x in r if x.n}
            return Region(conditions, mean.get(True, 0.0), mean.get(False, 0.0), self.failures)
        rest = all_stat - inside_stat
        return Region(conditions, float(inside_stat[1] / max(inside_stat[0], 1e-9)), float(rest[1] / rest[0]) if rest[0] else 0.0)


def _holds(bins: Column, taken: Sequence[tuple[int, int, bool]], failures: int) -> Column:
    failed = [F.when((F.element_at(bins, f + 1) > b) == F.lit(up), 0).otherwise(1) for f, b, up in taken]
    return reduce(lambda a, b: a + b, failed, F.lit(0)) <= failures


@dataclass
class CnfLearner:
    """A conjunction of clauses; a clause grows bin by bin of any feature while the penalised score falls.

    The penalty is 1 + rate ln(2 + bins + clauses).  At most `max_features`
    features take part in all.
    """

    grid: Grid
    clauses: int = 4
    rate: float = 0.1
    max_features: int = 7
    criterion: str = "L2GreedyTDRegion"

    def fit(self, df: DataFrame, y: Column, weight: Column | None = None, bins: str = "bins") -> Cnf:
        score = CRITERIA[self.criterion].score
        rows = df.select(bins, y.alias("_t"), (F.lit(1.0) if weight is None else weight).alias("_weight"))
        model: list[dict[int, set[int]]] = []
        best, inside_stat, all_stat = np.inf, None, None
        for _ in range(self.clauses + 1):
            table, everything = _inside_stats(rows, _cnf_holds(F.col(bins), model), bins, self.grid)
            inside_stat, all_stat = table[0].sum(axis=0), everything[0].sum(axis=0)
            if len(model) == self.clauses:
                break
            used = {f for clause in model for f in clause}
            found = None
            for f in range(len(self.grid.borders)):
                if f not in used and len(used) >= self.max_features:
                    continue
                chosen: set[int] = set()
                stat = np.zeros(3)
                while len(chosen) < len(self.grid.borders[f]):
                    options = []
                    for b in range(len(self.grid.borders[f]) + 1):
                        if b not in chosen:
                            part = stat + table[f, b]
                            cost = score(*map(float, part)) + score(*map(float, all_stat - part))
                            factor = 1 + self.rate * np.log(2 + len(chosen) + len(model))
                            options.append((cost / factor if cost < 0 else cost * factor, b))
                    now, b = min(options)
                    if found is not None and now >= found[0] and chosen or not now < best - 1e-12 and chosen:
                        break
                    chosen.add(b)
                    stat = stat + table[f, b]
                    if (found is None or now < found[0]) and now < best - 1e-12:
                        found = (now, f, set(chosen))
            if found is None:
                break
            best = found[0]
            model.append({found[1]: found[2]})
        clauses = [[(f, self.grid.borders[f], sorted(b)) for f, b in clause.items()] for clause in model]
        rest = all_stat - inside_stat
        return Cnf(clauses, float(inside_stat[1] / max(inside_stat[0], 1e-9)), float(rest[1] / rest[0]) if rest[0] else 0.0)


def _cnf_holds(bins: Column, model: Sequence[dict[int, set[int]]]) -> Column:
    out = F.lit(True)
    for clause in model:
        out = out & reduce(lambda a, b: a | b, [F.element_at(bins, f + 1).isin(sorted(s)) for f, s in clause.items()], F.lit(False))
    return out
