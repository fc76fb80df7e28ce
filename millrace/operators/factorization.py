"""Factorisation of matrices in long form (i, j, x): sums by row and column, nothing dense."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import cut


def als_step(cells: DataFrame, v: DataFrame, penalty: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """One rank-1 step from (j, v): u = X v / (1 + penalty), then v = X'u / (|u|^2 + penalty)."""
    u = cells.join(v, "j").groupBy("i").agg((F.sum(F.col("x") * F.col("v")) / (1 + penalty)).alias("u"))
    size = u.agg(F.sum(F.col("u") * F.col("u")).alias("s"))
    new = cells.join(u, "i").groupBy("j").agg(F.sum(F.col("x") * F.col("u")).alias("t"))
    return u, new.crossJoin(F.broadcast(size)).select("j", (F.col("t") / (F.col("s") + penalty)).alias("v"))  # one row


def normalised(v: DataFrame) -> DataFrame:
    """(j, v) of length 1."""
    size = v.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("s"))
    return v.crossJoin(F.broadcast(size)).select("j", F.when(F.col("s") > 0, F.col("v") / F.col("s")).otherwise(0.0).alias("v"))  # one row


def als(cells: DataFrame, rounds: int = 5, penalty: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Rank-1 factors (i, u) and (j, v) with x near u v and |v| = 1."""
    v = normalised(cells.select("j").distinct().withColumn("v", F.lit(1.0)))
    u = None
    for _ in range(rounds):
        _, raw = als_step(cells, v, penalty)
        v = cut(normalised(raw))
    u = cells.join(v, "j").groupBy("i").agg((F.sum(F.col("x") * F.col("v")) / (1 + penalty)).alias("u"))
    return u, v


def soft_als(cells: DataFrame, rounds: int = 5, shrink: float = 0.0, ridge: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Rank-1 factors whose entries are shrunk toward 0: alternating elastic nets."""

    def shrunk(x):
        return F.signum(x) * F.greatest(F.abs(x) - shrink, F.lit(0.0))

    v = normalised(cells.select("j").distinct().withColumn("v", F.lit(1.0)))
    u = None
    for _ in range(rounds):
        u = cells.join(v, "j").groupBy("i").agg((shrunk(F.sum(F.col("x") * F.col("v"))) / (1 + ridge)).alias("u"))
        raw = cells.join(u, "i").groupBy("j").agg(shrunk(F.sum(F.col("x") * F.col("u"))).alias("v"))
        v = cut(normalised(raw))
    return u, v


def gradient_factors(gradient: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """h, b with the rank-1 matrix h b' nearest to a block of gradients, |b| = 1."""
    b = np.ones(gradient.shape[1]) / np.sqrt(max(gradient.shape[1], 1))
    for _ in range(rounds):
        h = gradient @ b
        b = gradient.T @ h
        b = b / max(np.linalg.norm(b), 1e-300)
    return gradient @ b, b
