"""Splits, folds and bootstraps decided by hashes of keys: the same on any cluster, and in SQL."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unit(key: Column, salt: str = "") -> Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of a key's md5."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def assigned(key: Column, shares: Sequence[float], salt: str = "") -> Column:
    """Part of each row, from 0, with given shares."""
    u, edge, out = unit(key, salt), 0.0, F.lit(len(shares) - 1)
    ladder = []
    for i, share in enumerate(shares[:-1]):
        edge += share / sum(shares)
        ladder.append((edge, i))
    for edge, i in reversed(ladder):
        out = F.when(u < edge, i).otherwise(out)
    return out.cast("int")


def split(df: DataFrame, key: str, share: float = 0.8, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Learn and test rows; all rows of a key are on one side (give a group's key to keep groups whole)."""
    learn = unit(F.col(key), salt) < share
    return df.where(learn), df.where(~learn)


def poisson(key: Column, salt: str = "", most: int = 7) -> Column:
    """Bootstrap weight, Poisson of mean 1, by the inverse distribution function."""
    u, p, total, out = unit(key, salt), np.exp(-1.0), 0.0, F.lit(most)
    edges = []
    for k in range(most):
        total += p
        edges.append((total, k))
        p /= k + 1
    for edge, k in reversed(edges):
        out = F.when(u < float(edge), k).otherwise(out)
    return out.cast("int")


def bootstrap(df: DataFrame, key: str, weight: str = "weight", salt: str = "", by: Column | None = None) -> DataFrame:
    """`df` with bootstrap weights, times given weights if any."""
    w = poisson(F.col(key), salt).cast("double")
    return df.withColumn(weight, w if by is None else w * by)


def fold(key: Column, k: int, salt: str = "") -> Column:
    """Fold of each row, 0 to k - 1."""
    return F.floor(unit(key, salt) * k).cast("int")


def folds(df: DataFrame, key: str, k: int, salt: str = "") -> Iterable[tuple[DataFrame, DataFrame]]:
    """(learn, test) of each fold: learn has all rows of the other folds."""
    marked = df.withColumn("_fold", fold(F.col(key), k, salt))
    for i in range(k):
        yield marked.where(F.col("_fold") != i).drop("_fold"), marked.where(F.col("_fold") == i).drop("_fold")


def time_border(df: DataFrame, ts: str, ratio: float) -> DataFrame:
    """The time at place floor(n ratio) in order of time, in one row.

    Times are counted first, so the ordered window sees distinct times.
    """
    counts = df.groupBy(ts).agg(F.count("*").alias("n"))
    up = Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    seen = counts.withColumn("up", F.sum("n").over(up)).crossJoin(F.broadcast(df.agg(F.count("*").alias("all"))))  # one row
    return seen.where(F.col("up") > F.floor(F.col("all") * ratio)).agg(F.min(ts).alias("border"))


def time_split(df: DataFrame, ts: str, ratio: float) -> DataFrame:
    """`df` with `train`: at or before the border."""
    return df.crossJoin(F.broadcast(time_border(df, ts, ratio))).withColumn("train", F.col(ts) <= F.col("border")).drop("border")


def prefix_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], ratio: float, least: int = 2) -> DataFrame:
    """`df` with `train`: the first floor(n ratio) rows of each key; keys with fewer than `least` of them go."""
    at, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    size = F.floor(F.count("*").over(whole) * ratio)
    marked = df.withColumn("_size", size).withColumn("train", F.row_number().over(at) <= F.col("_size"))
    return marked.where(F.col("_size") >= least).drop("_size")


def grid(ranges: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of parameter values."""
    return [dict(zip(ranges, values)) for values in itertools.product(*ranges.values())]


def parse_ranges(text: str) -> dict[str, list[float]]:
    """Parameter ranges "name=a:b:step;other=x,y": from a to b in steps, or listed values."""
    out = {}
    for item in filter(None, (x.strip() for x in text.split(";"))):
        name, _, values = item.partition("=")
        if ":" in values:
            a, b, step = (float(v) for v in values.split(":"))
            out[name.strip()] = [a + i * step for i in range(int(np.floor((b - a) / step + 1e-9)) + 1)]
        else:
            out[name.strip()] = [float(v) for v in values.split(",")]
    return out


def signed_rank(a: Sequence[float], b: Sequence[float]) -> float:
    """Two-sided p-value of Wilcoxon's signed-rank test, by the normal approximation with ties."""
    d = np.array(a, float) - np.array(b, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    size = np.abs(d)
    values, where, many = np.unique(size, return_inverse=True, return_counts=True)
    rank = (np.cumsum(many) - (many - 1) / 2)[where]
    plus = rank[d > 0].sum()
    spread = n * (n + 1) * (2 * n + 1) / 24 - (many**3 - many).sum() / 48
    if spread <= 0:
        return 1.0
    z = (abs(plus - n * (n + 1) / 4) - 0.5) / np.sqrt(spread)
    import math

    return float(min(1.0, math.erfc(max(z, 0.0) / math.sqrt(2))))


def gibbs_permutation(weights: Sequence[float], rounds: int, seed: int = 1) -> list[int]:
    """A permutation drawn by Gibbs steps, with weight e^-(w_i place_i)."""
    rng, order = np.random.default_rng(seed), list(range(len(weights)))
    for _ in range(rounds):
        i, j = rng.integers(0, len(order), 2)
        gain = (weights[order[i]] - weights[order[j]]) * (j - i)
        if rng.random() < 1 / (1 + np.exp(np.clip(gain, -50, 50))):
            order[i], order[j] = order[j], order[i]
    return order
