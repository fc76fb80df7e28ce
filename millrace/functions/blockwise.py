"""Losses of a row's whole block of outputs: several classes, several labels, vectors.

A block is an `array<double>` column with one logit (or value) an output.  Row
values are summed map-side like any other aggregate; steps are by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.losses import likelihood
from millrace.functions.vectors import dot, log_sigmoid, multi_logit, sigmoid, total


def _log_partition(x: Column) -> Column:
    """ln(1 + sum of e^x), without overflow."""
    top = F.greatest(F.array_max(x), F.lit(0.0))
    return top + F.log(F.exp(-top) + total(F.transform(x, lambda v: F.exp(v - top))))


def class_likelihood(label: Column, x: Column) -> Column:
    """Log-likelihood of a row's class; the class after the last logit is the reference, with logit 0."""
    own = F.when(label < F.size(x), F.get(x, label.cast("int"))).otherwise(0.0)
    return own - _log_partition(x)


def class_step(label: Column, x: Column) -> Column:
    """Gradient of the negative log-likelihood by the logits: probabilities, less 1 at the row's class."""
    return F.transform(multi_logit(x), lambda p, i: p - F.when(i == label, 1.0).otherwise(0.0))


def class_value(label: Column, x: Column) -> Column:
    """exp of the mean log-likelihood, over a table."""
    return F.exp(F.avg(class_likelihood(label, x)))


def predicted_class(x: Column) -> Column:
    """The first largest logit's class if that logit is above 0, else the reference class."""
    top = F.array_max(x)
    return F.when(top > 0, F.array_position(x, top) - 1).otherwise(F.size(x)).cast("int")


def class_accuracy(label: Column, x: Column) -> Column:
    """Share of rows whose class is the predicted one."""
    return F.avg(F.when(predicted_class(x) == label, 1.0).otherwise(0.0))


def label_set_likelihood(labels: Column, x: Column) -> Column:
    """Log-likelihood of a row's set of labels among all sets of labels, the empty set counted twice.

    The sum of e^(sum of x over a set) over all sets is the product of 1 + e^x,
    so that nothing is enumerated.
    """
    sets = total(F.transform(x, lambda v: -log_sigmoid(-v)))
    return dot(labels, x) + log_sigmoid(-sets)


def label_set_step(labels: Column, x: Column) -> Column:
    """Gradient by the logits: how likely each label is among all sets (once each), less 1 where the row has it."""
    return F.zip_with(labels, x, lambda y, v: sigmoid(v) - F.when(F.abs(y - 1) < 1e-10, 1.0).otherwise(0.0))


def one_vs_rest_value(labels: Column, x: Column, n_labels: int) -> Column:
    """Mean over the labels of exp(mean log-likelihood) of each label's own logit."""
    values = [likelihood(F.element_at(labels, j + 1), F.element_at(x, j + 1)) for j in range(n_labels)]
    return sum(values[1:], values[0]) / n_labels


def squares(y: Column, x: Column) -> Column:
    """Squared distance of a row's block from its target."""
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def square_step(y: Column, x: Column) -> Column:
    """Gradient of the squared distance."""
    return F.zip_with(x, y, lambda a, b: 2 * (a - b))


def square_value(y: Column, x: Column) -> Column:
    """Root of the mean square over all outputs of all rows."""
    return F.sqrt(F.sum(squares(y, x)) / F.sum(F.size(y)))


def weighted_row(value: Callable[[Column, Column], Column], w: Column) -> Callable[[Column, Column], Column]:
    """A row's value times its whole-number weight; rows of weight 0 or less give 0, whatever their value."""
    return lambda y, x: F.when(w > 0, w * value(y, x)).otherwise(0.0)


def weighted_step(step: Callable[[Column, Column], Column], w: Column) -> Callable[[Column, Column], Column]:
    """A row's step times its weight; rows of weight 0 or less give a step of zeros."""
    return lambda y, x: F.transform(step(y, x), lambda g: F.when(w > 0, w * g).otherwise(0.0))
