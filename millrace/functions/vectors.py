"""Scalar and vector functions as column expressions.

Vectors are `array<double>` columns.  Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Sum of a vector."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    """Inner product of two vectors."""
    return total(F.zip_with(x, y, lambda a, b: a * b))


def weights(w: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in w]) if len(w) else F.array().cast("array<double>")


def log_linear(x: Column, a: float = 1.0, b: float = 0.0) -> Column:
    """ln(a x + b)."""
    return F.log(a * x + b)


def power(x: Column, a: float, b: float) -> Column:
    """a x^b."""
    return a * F.pow(x, F.lit(b))


def relu(x: Column) -> Column:
    """max(x, 0)."""
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x), without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def log_sigmoid(x: Column) -> Column:
    """ln of the sigmoid, stable for large |x|."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def logit(x: Column, a: float = 1.0, b: float = 0.0) -> Column:
    """-ln(1 + e^(a x + b))."""
    return log_sigmoid(-(a * x + b))


def multi_logit(x: Column) -> Column:
    """Softmax with an implicit reference class of logit 0; the reference isn't in the result."""
    top = F.greatest(F.array_max(x), F.lit(0.0))
    parts = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(parts, lambda e: e / (F.exp(-top) + total(parts)))


def weighted_multi_logit(x: Column, w: Sequence[float]) -> Column:
    """`multi_logit` of weighted logits."""
    return multi_logit(F.zip_with(x, weights(w), lambda a, b: a * b))


def log_softmax(x: Column, label: Column) -> Column:
    """Log-probability of a class (from 0) under the full softmax."""
    top = F.array_max(x)
    return F.element_at(x, label + 1) - top - F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def sum_sigmoid(x: Column) -> Column:
    """Sigmoid of a vector's sum."""
    return sigmoid(total(x))


def linear(x: Column, w: Sequence[float], bias: float = 0.0) -> Column:
    """w x + bias."""
    return dot(x, weights(w)) + bias


def normalized_linear(x: Column, w: Sequence[float], scale: Sequence[float], mean: Sequence[float], average: float) -> Column:
    """w (scale * x + mean) + average."""
    scaled = F.zip_with(F.zip_with(x, weights(scale), lambda a, b: a * b), weights(mean), lambda a, b: a + b)
    return linear(scaled, w, average)


def noisy_or(x: Column) -> Column:
    """1 - product of (1 - x)."""
    return 1 - F.aggregate(x, F.lit(1.0), lambda a, v: a * (1 - v))


def parallel(x: Column, f: Callable[[Column], Column]) -> Column:
    """A function of each component."""
    return F.transform(x, f)


def part(x: Column, start: int, length: int) -> Column:
    """Components start .. start + length - 1, from 0."""
    return F.slice(x, start + 1, length)


def scaled(f: Column, vector: Sequence[float]) -> Column:
    """A vector times a scalar function."""
    return F.transform(weights(vector), lambda v: v * f)


def join_scalars(*fs: Column) -> Column:
    """Scalar functions as one vector."""
    return F.array(*fs)


def join_vectors(*fs: Column) -> Column:
    """Vector functions, concatenated."""
    return F.concat(*fs)


def ensemble(models: Sequence[tuple[float, Column]]) -> Column:
    """Weighted sum of models."""
    out = F.lit(0.0)
    for w, m in models:
        out = out + F.lit(float(w)) * m
    return out


def argmax(x: Column) -> Column:
    """Place of the largest component, from 0; the first one on ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def reference_class(x: Column, strict: bool = False) -> Column:
    """Class of logits with an implicit reference class last: arg-max if its logit is (more than) 0."""
    top = F.array_max(x)
    return F.when((top > 0) if strict else (top >= 0), argmax(x)).otherwise(F.size(x))


def reference_probabilities(x: Column) -> Column:
    """Probabilities of all classes, the reference class last."""
    p = multi_logit(x)
    return F.concat(p, F.array(1 - total(p)))


def factorization_machine(x: Column, w0: float, w: Sequence[float], v: Sequence[Sequence[float]]) -> Column:
    """w0 + w x + half of the sum over factors of (v x)^2 - v^2 x^2; `v` holds a row a factor."""
    out = F.lit(float(w0)) + dot(x, weights(w))
    for row in v:
        cross = dot(x, weights(row))
        own = total(F.zip_with(x, weights(row), lambda a, b: a * a * b * b))
        out = out + 0.5 * (cross * cross - own)
    return out


def norm(x: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    d = norm(x) * norm(y)
    return F.when(d > 0, dot(x, y) / d)


def distance(x: Column, y: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def java_hash(text: Column) -> Column:
    """Java's String.hashCode: 31 h + c over UTF-16 units, wrapped to 32 bits."""
    units = F.encode(text, "UTF-16BE")
    digits = F.hex(units)
    places = F.sequence(F.lit(0), F.greatest((F.length(units) / 2 - 1).cast("int"), F.lit(0)))
    codes = F.transform(places, lambda i: F.conv(F.substring(digits, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    empty = F.length(units) == 0
    return F.when(empty, 0).when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped).cast("long")


def categorical(text: Column) -> Column:
    """A categorical value as a number: its Java hash over 2^32."""
    return java_hash(text) / F.lit(float(1 << 32))


def normalize_word(word: Column) -> Column:
    """A word in lower case without non-alphanumeric characters at its ends."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def bin_of(x: Column, borders: Sequence[float]) -> Column:
    """Number of borders below x; not-a-number is bin 0."""
    above = [F.when((x > F.lit(float(b))) & ~F.isnan(x), 1).otherwise(0) for b in borders]
    out = F.lit(0)
    for a in above:
        out = out + a
    return out


def bucket(y: Column, borders: Sequence[float]) -> Column:
    """Class of a regression target: number of borders that it exceeds, the last class at most."""
    return F.least(bin_of(y, borders), F.lit(max(0, len(borders) - 1)))


def equal_borders(least: float, most: float, classes: int, from_least: bool = True) -> list[float]:
    """Equal-width borders of classes; without `from_least` they start from 0, as if the least were 0."""
    step = (most - least) / classes
    return [(least if from_least else 0.0) + step * (i + 1) for i in range(classes)]
