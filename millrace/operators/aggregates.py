"""Additive statistics: histograms of bins, splits, task means, smoothed rates, mixtures."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.losses import CRITERIA


def histogram(df: DataFrame, bins: str, y: Column, w: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Weight, sum and sum of squares of each (feature, bin), and leaf if given.

    Partial sums are made before the shuffle, so what moves is a row for each
    bin and task, whatever the rows.
    """
    w = F.lit(1.0) if w is None else w
    rows = df.select(*by, F.posexplode(bins).alias("feature", "bin"), w.alias("_w"), y.alias("_y"))
    return rows.groupBy(*by, "feature", "bin").agg(
        F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("s"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("s2")
    )


def merged(*histograms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Histograms of parts as one: they add up."""
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))


def removed(whole: DataFrame, part: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A histogram without a part of its rows: they subtract."""
    negative = part.withColumns({c: -F.col(c) for c in ("n", "s", "s2")})
    return merged(whole, negative, by=by)


def splits(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Left and right statistics of each split of a histogram; left has the bins up to `bin`."""
    up = Window.partitionBy(*by, "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by, "feature")
    left = {f"left_{c}": F.sum(c).over(up) for c in ("n", "s", "s2")}
    right = {f"right_{c}": F.sum(c).over(every) - F.sum(c).over(up) for c in ("n", "s", "s2")}
    return hist.withColumns({**left, **right})


def intervals(hist: DataFrame) -> DataFrame:
    """Statistics inside and outside every interval of bins of a feature (a small table squared, by feature)."""
    s = splits(hist).select("feature", "bin", "n", "s", "s2", "left_n", "left_s", "left_s2", "right_n", "right_s", "right_s2")
    a, b = s.alias("a"), s.alias("b")
    on = (F.col("a.feature") == F.col("b.feature")) & (F.col("a.bin") <= F.col("b.bin"))
    inside = {c: F.col(f"b.left_{c}") - F.col(f"a.left_{c}") + F.col(f"a.{c}") for c in ("n", "s", "s2")}
    total = {c: F.col(f"a.left_{c}") + F.col(f"a.right_{c}") for c in ("n", "s", "s2")}
    return a.join(b, on).select(
        F.col("a.feature").alias("feature"), F.col("a.bin").alias("first_bin"), F.col("b.bin").alias("last_bin"),
        *[v.alias(f"in_{c}") for c, v in inside.items()], *[(total[c] - inside[c]).alias(f"out_{c}") for c in inside],
    )


def scored_splits(hist: DataFrame, criterion: str = "SatL2", by: Sequence[str] = ()) -> DataFrame:
    """Score of each split, added over leaves, smaller is better."""
    score = CRITERIA[criterion].score
    s = splits(hist, by)
    value = score(F.col("left_n"), F.col("left_s"), F.col("left_s2")) + score(F.col("right_n"), F.col("right_s"), F.col("right_s2"))
    return s.withColumn("score", value).groupBy("feature", "bin").agg(F.sum("score").alias("score"))


def kernel_sums(values: Sequence[float], decay: float) -> list[float]:
    """For each place i the sum over j of e^(-decay |i - j|) values[j], in one pass each way."""
    q, n = math.exp(-decay), len(values)
    left, right = [0.0] * n, [0.0] * n
    for i in range(n):
        left[i] = values[i] + (q * left[i - 1] if i else 0.0)
        right[n - 1 - i] = (q * (values[n - i] + right[n - i])) if i else 0.0
    return [a + b for a, b in zip(left, right)]


def smoothed_rates(df: DataFrame, parent: str, child: str, hit: Column, weight: float = 10.0) -> DataFrame:
    """(hits + weight p) / (n + weight) of each (parent, child), p that of the parent, its p that of all rows."""
    counts = df.groupBy(parent, child).agg(F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("c"))
    up = counts.groupBy(parent).agg(F.sum("n").alias("pn"), F.sum("c").alias("pc"))
    all_ = up.agg((F.sum("pc") / F.sum("pn")).alias("p0"))
    p1 = (F.col("pc") + weight * F.col("p0")) / (F.col("pn") + weight)
    parents = up.crossJoin(F.broadcast(all_)).select(parent, p1.alias("p1"))  # one row
    return counts.join(parents, parent).select(parent, child, "n", ((F.col("c") + weight * F.col("p1")) / (F.col("n") + weight)).alias("rate"))


def task_means(df: DataFrame, task: str, y: str) -> DataFrame:
    """n, mean and variance of the mean of each task."""
    s = df.groupBy(task).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("variance"))
    return s.withColumn("error", F.col("variance") / F.col("n"))


def stein_means(df: DataFrame, task: str, y: str, prior: float | None = None) -> DataFrame:
    """Task means shrunk toward a prior (the grand mean if none) by the positive-part Stein factor.

    Fewer than four tasks keep their means.
    """
    m = task_means(df, task, y)
    centre = F.lit(prior) if prior is not None else F.sum(F.col("mean") * F.col("n")) / F.sum("n")
    facts = m.agg(
        F.count("*").alias("_tasks"), F.sum("error").alias("_se"), F.max("error").alias("_me"), centre.alias("_centre") if prior is None else F.first(centre).alias("_centre")
    )
    with_facts = m.crossJoin(F.broadcast(facts))  # one row
    spread = with_facts.agg(F.sum(F.when(F.col("error") > 0, F.pow(F.col("mean") - F.col("_centre"), F.lit(2.0)) / F.col("error"))).alias("_spread"))
    full = with_facts.crossJoin(F.broadcast(spread))  # one row
    keep = F.when((F.col("_tasks") < 4) | (F.col("_spread") <= 0) | F.col("_spread").isNull(), 1.0).otherwise(
        F.greatest(1 - (F.col("_se") / F.col("_me") - 3) / F.col("_spread"), F.lit(0.0))
    )
    return full.select(task, "n", "mean", (F.col("_centre") + keep * (F.col("mean") - F.col("_centre"))).alias("shrunk"))


def multi_task_means(df: DataFrame, task: str, y: str, kind: str = "const") -> DataFrame:
    """Task means drawn to each other as strongly as their differences allow.

    "const" uses the mean squared difference of means, "minimax" the largest.
    """
    m = task_means(df, task, y)
    moments = m.agg(
        F.count("*").alias("_t"), F.sum("mean").alias("_sm"), F.sum(F.col("mean") * F.col("mean")).alias("_sq"),
        F.max("mean").alias("_hi"), F.min("mean").alias("_lo"), F.avg("error").alias("_err"),
    )
    apart = (2 * F.col("_t") * F.col("_sq") - 2 * F.col("_sm") * F.col("_sm")) / (F.col("_t") * (F.col("_t") - 1))
    gap = F.when(F.col("_t") > 1, apart) if kind == "const" else F.pow(F.col("_hi") - F.col("_lo"), F.lit(2.0))
    tie = F.when(gap > 0, F.when(F.lit(kind == "const"), 2.0).otherwise(1.0) / gap).otherwise(0.0)
    facts = moments.select("_t", "_sm", "_err", tie.alias("_tie"))
    full = m.crossJoin(F.broadcast(facts))  # one row
    share = F.col("_err") * F.col("_tie") / 1.0
    return full.select(task, "n", "mean", ((F.col("mean") + share * F.col("_sm") / F.col("_t")) / (1 + share)).alias("shrunk"))


def binomial_mixture(counts: list[tuple[int, int, int]], k: int, rounds: int = 50, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rates of k binomial components by EM, from (hits, trials, how many) rows.

    Rows are the distinct (hits, trials) of a table, aggregated before.
    """
    m, n, c = (np.array(x, float) for x in zip(*counts))
    rng = np.random.default_rng(seed)
    q, theta = np.full(k, 1 / k), np.sort(rng.uniform(0.05, 0.95, k))
    for _ in range(rounds):
        logs = np.log(q) + m[:, None] * np.log(theta) + (n - m)[:, None] * np.log1p(-theta)
        part = np.exp(logs - logs.max(axis=1, keepdims=True))
        part *= (c / part.sum(axis=1))[:, None]
        theta = np.clip((part * m[:, None]).sum(axis=0) / np.maximum((part * n[:, None]).sum(axis=0), 1e-12), 1e-6, 1 - 1e-6)
        q = np.maximum(part.sum(axis=0) / c.sum(), 1e-12)
        q /= q.sum()
    order = np.argsort(theta)
    return q[order], theta[order]


def hit_counts(df: DataFrame, key: str, hit: Column) -> DataFrame:
    """How many keys have each (hits, trials): what mixtures are fitted to."""
    by = df.groupBy(key).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), F.count("*").alias("trials"))
    return by.groupBy("hits", "trials").agg(F.count("*").alias("n"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln gamma, by recurrence and the asymptotic series."""
    x, out = np.array(x, float), 0.0
    for _ in range(6):
        out, x = out - 1 / x, x + 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def beta_binomial_mixture(
    counts: list[tuple[int, int, int]], k: int, rounds: int = 200, seed: int = 1, pull: float = 0.0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, alpha and beta of k beta-binomial components by generalised EM.

    The M-step is a fixed-point step on (alpha, beta); `pull` > 0 regularises
    both toward 1.  Parameters are at least 0.001.
    """
    m, n, c = (np.array(x, float) for x in zip(*counts))
    rng = np.random.default_rng(seed)
    order = np.argsort(m / n)
    share = np.cumsum(c[order]) / c.sum()
    start = np.clip((m / n)[order][np.searchsorted(share, (np.arange(k) + 0.5) / k)], 0.05, 0.95)
    q, a, b = np.full(k, 1 / k), 4 * start * rng.uniform(0.9, 1.1, k), 4 * (1 - start)
    ln = np.vectorize(math.lgamma)
    for _ in range(rounds):
        logs = np.log(q) + ln(m[:, None] + a) + ln((n - m)[:, None] + b) - ln(n[:, None] + a + b) - ln(a) - ln(b) + ln(a + b)
        part = np.exp(logs - logs.max(axis=1, keepdims=True))
        part *= (c / part.sum(axis=1))[:, None]
        down = (part * (digamma(n[:, None] + a + b) - digamma(a + b))).sum(axis=0) + 1e-12
        up_a = (part * (digamma(m[:, None] + a) - digamma(a))).sum(axis=0)
        up_b = (part * (digamma((n - m)[:, None] + b) - digamma(b))).sum(axis=0)
        a = np.maximum(0.001, a * (up_a + pull / a) / (down + pull))
        b = np.maximum(0.001, b * (up_b + pull / b) / (down + pull))
        q = np.maximum(part.sum(axis=0) / c.sum(), 1e-12)
        q /= q.sum()
    return q, a, b


def class_hierarchy(counts: Sequence[tuple[int, int]], least: int = 1) -> dict:
    """A binary tree over ordered classes; each split makes the two sides' counts as equal as it can.

    A side with at most `least` rows is pruned to a leaf.
    """
    classes = [c for c, _ in counts]
    total = sum(n for _, n in counts)
    node: dict = {"classes": classes, "n": total}
    if len(counts) < 2 or total <= least:
        return node
    best, left = None, 0
    for i in range(len(counts) - 1):
        left += counts[i][1]
        gap = abs(2 * left - total)
        if best is None or gap < best[0]:
            best = (gap, i + 1, left)
    _, at, left = best
    if left > least and total - left > least:
        node["left"], node["right"] = class_hierarchy(counts[:at], least), class_hierarchy(counts[at:], least)
    return node
