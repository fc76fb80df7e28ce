"""Losses: leaf criteria on additive statistics, pointwise gradients, values of a whole table.

A criterion is a function of a leaf's weight n, sum s and sum of squares s2; it
works on numbers and on columns alike, so that the same code scores splits on
the driver and in a plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.vectors import log_sigmoid, sigmoid

#: Below this weight a leaf counts as empty.
EPS = 1e-8


def _if(condition: Any, yes: Any, no: Any) -> Any:
    if isinstance(condition, Column):
        return F.when(condition, yes).otherwise(no)
    return yes if condition else no


def _ln(x: Any) -> Any:
    return F.log(x) if isinstance(x, Column) else math.log(x)


def _safe(n: Any) -> Any:
    return F.greatest(n, F.lit(EPS)) if isinstance(n, Column) else max(n, EPS)


def _part(n: Any, at_least: float) -> Any:
    """n where it is larger than the bound, else a harmless number (the branch isn't taken)."""
    if isinstance(n, Column):
        return F.when(n > at_least, n).otherwise(F.lit(at_least + 1.0))
    return n if n > at_least else at_least + 1.0


def mean_leaf(n: Any, s: Any) -> Any:
    """Mean of the leaf, 0 for an empty one."""
    return _if(n > EPS, s / _safe(n), 0.0)


def l2(n: Any, s: Any, s2: Any) -> Any:
    return _if(n > EPS, -s * s / _safe(n), 0.0)


def sat_l2(n: Any, s: Any, s2: Any) -> Any:
    m = _part(n, 2)
    return _if(n > 2, m * (m - 2) / (m * m - 3 * m + 1) * (s2 - s * s / m), s2)


def leave_one_out(n: Any, s: Any, s2: Any) -> Any:
    m = _part(n, 1)
    return _if(n > 1, -s * s / m * (m / (m - 1)) * (m / (m - 1)), 0.0)


def log_l2(n: Any, s: Any, s2: Any) -> Any:
    return _if(n > EPS, -s * s / _safe(n) * _ln(_safe(n) + 1), 0.0)


def corrected_l2(n: Any, s: Any, s2: Any) -> Any:
    m = _part(n, 2)
    return _if(n > 2, m / (m - 1) * (s2 - s * s / m), s2)


def combined_l2(n: Any, s: Any, s2: Any) -> Any:
    m = _part(n, 1)
    return _if(n > 1, -s * s / m * (m / (m - 1)) * (m / (m - 1)) * (1 + 2 * _ln(m + 1)), 0.0)


def l2_reg(n: Any, s: Any, s2: Any) -> Any:
    m = _part(n, 2)
    return _if(n > 2, -s * s / m * m * (m - 2) / (m * m - 3 * m + 1) * (1 + 2 * _ln(m + 1)), 0.0)


@dataclass(frozen=True)
class Criterion:
    """How a weak learner scores leaves (smaller is better) and values them."""

    name: str
    score: Callable[[Any, Any, Any], Any]
    leaf: Callable[[Any, Any], Any] = mean_leaf


CRITERIA = {
    "L2": Criterion("L2", l2),
    "SatL2": Criterion("SatL2", sat_l2, lambda n, s: _if(n > 2, s / _safe(n), 0.0)),
    "LOOL2": Criterion("LOOL2", leave_one_out),
    "LogL2": Criterion("LogL2", log_l2),
    "CorrL2": Criterion("CorrL2", corrected_l2),
    "CombL2": Criterion("CombL2", combined_l2),
    "L2Reg": Criterion("L2Reg", l2_reg, lambda n, s: s / (n + 1)),
    "L2GreedyTDRegion": Criterion("L2GreedyTDRegion", leave_one_out),
}
for _name in ("L2", "SatL2"):
    CRITERIA["Weighted" + _name] = Criterion("Weighted" + _name, CRITERIA[_name].score, CRITERIA[_name].leaf)


@dataclass(frozen=True)
class Target:
    """A loss bound to columns: its value over a table (an aggregate) and its antigradient by row.

    `larger` says whether larger values are better.
    """

    name: str
    value: Callable[[Column, Column], Column]
    step: Callable[[Column, Column], Column]
    larger: bool = False


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def likelihood(y: Column, x: Column) -> Column:
    """exp of the mean log-likelihood of logits; a target above 0 is positive."""
    return F.exp(F.avg(F.when(y > 0, log_sigmoid(x)).otherwise(log_sigmoid(-x))))


def log_loss(y: Column, p: Column) -> Column:
    """Sum of log-likelihoods of probabilities."""
    return F.sum(F.when(y > 0, F.log(p)).otherwise(F.log(1 - p)))


def misclassification(y: Column, x: Column) -> Column:
    """Mean probability of the wrong class."""
    return F.avg(F.when(y > 0, 1 - sigmoid(x)).otherwise(sigmoid(x)))


def likelihood_x2(y: Column, x: Column) -> Column:
    """Negative log-likelihood with p = e^-(x + 1)^2."""
    p = F.exp(-(x + 1) * (x + 1))
    return -F.sum(F.when(y > 0, F.log(p)).otherwise(F.log(1 - p)))


def mixture(y: Column, x: Column, c: Column) -> Column:
    """Likelihood where a row is positive with probability c + p (1 - c)."""
    p = c + sigmoid(x) * (1 - c)
    return F.exp(F.avg(F.when(y > 0, F.log(p)).otherwise(F.log(1 - p))))


def choice_mixture(y: Column, x: Column, alpha: Column) -> Column:
    """Likelihood of alpha c + (1 - alpha) p with c = sigmoid(x) and p its complement."""
    p = alpha * sigmoid(x) + (1 - alpha) * sigmoid(-x)
    return F.exp(F.avg(F.when(y > 0, F.log(p)).otherwise(F.log(1 - p))))


def exclusive_mixture(y: Column, x: Column, c: Column, alpha: float) -> Column:
    """Likelihood of c (alpha + (1 - alpha) p)."""
    p = c * (alpha + (1 - alpha) * sigmoid(x))
    return F.exp(F.avg(F.when(y > 0, F.log(p)).otherwise(F.log(1 - p))))


def weighted(value: Callable[[Column, Column, Column], Column], w: Column) -> Callable[[Column, Column], Column]:
    """A loss with row weights, as a loss."""
    return lambda y, p: value(y, p, w)


def weighted_rmse(y: Column, p: Column, w: Column) -> Column:
    return F.sqrt(F.sum(w * (y - p) * (y - p)) / F.sum(w))


def weighted_likelihood(y: Column, x: Column, w: Column) -> Column:
    return F.exp(F.sum(w * F.when(y > 0, log_sigmoid(x)).otherwise(log_sigmoid(-x))) / F.sum(w))


TARGETS = {
    "L2": Target("L2", rmse, lambda y, p: y - p),
    "LLLogit": Target("LLLogit", likelihood, lambda y, x: F.when(y > 0, 1 - sigmoid(x)).otherwise(-sigmoid(x)), True),
    "CELogit": Target("CELogit", misclassification, lambda y, x: F.when(y > 0, 1.0).otherwise(-1.0) * sigmoid(x) * (1 - sigmoid(x))),
    "LL": Target("LL", log_loss, lambda y, p: F.when(y > 0, 1 / p).otherwise(-1 / (1 - p)), True),
}
