"""Cross validation, grid search, and comparison of schemes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.losses import TARGETS
from millrace.operators.sampling import folds, grid, signed_rank
from millrace.plans.scheme import Context, build


def scores(df: DataFrame, y: Column, scheme: str, context: Context, loss: str = "L2", k: int = 5, features: str = "features") -> list[float]:
    """The loss on each fold, learned on the others."""
    out = []
    for learn, test in folds(df, context.key, k, "cv"):
        model = build(scheme, context).fit(learn, y)
        out.append(float(test.agg(TARGETS[loss].value(y, model.column(F.col(features)))).first()[0]))
    return out


def compare(df: DataFrame, y: Column, schemes: Sequence[str], context: Context, loss: str = "L2", k: int = 5) -> list[tuple]:
    """(scheme, mean, difference from the first, p-value of the difference)."""
    found = [scores(df, y, s, context, loss, k) for s in schemes]
    first = found[0]
    return [(s, sum(f) / len(f), sum(f) / len(f) - sum(first) / len(first), signed_rank(f, first)) for s, f in zip(schemes, found)]


def search(learn: DataFrame, test: DataFrame, y: Column, scheme: str, ranges: dict[str, Sequence], context: Context, losses: Sequence[str] = ("L2",)) -> dict:
    """The best parameters of a scheme template ("...{name}...") for each loss."""
    best: dict = {}
    for values in grid(ranges):
        model = build(scheme.format(**values), context).fit(learn, y)
        row = test.agg(*[TARGETS[n].value(y, model.column(F.col("features"))).alias(n) for n in losses]).first()
        for n in losses:
            sign = -1 if TARGETS[n].larger else 1
            if n not in best or sign * row[n] < sign * best[n][0]:
                best[n] = (row[n], values)
    return best
