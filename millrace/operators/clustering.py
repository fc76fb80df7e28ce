"""Clustering: k-means by aggregation, leader clustering in order, components of shared dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import vectors as V
from millrace.operators.components import connected


def assigned(df: DataFrame, vector: str, centres: list[list[float]], out: str = "cluster") -> DataFrame:
    """`df` with the nearest of k centres, the first on ties; centres are literals of the plan."""
    d = F.array(*[V.distance(F.col(vector), V.weights(c)) for c in centres])
    return df.withColumn(out, (F.array_position(d, F.array_min(d)) - 1).cast("int"))


def k_means_step(df: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """(cluster, n, centre) after one step: rows to the nearest centre, then means."""
    width = len(centres[0])
    marked = assigned(df, vector, centres)
    means = [F.avg(F.element_at(vector, i + 1)) for i in range(width)]
    return marked.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*means).alias("centre"))


def k_means(df: DataFrame, vector: str, key: str, k: int, rounds: int = 10) -> list[list[float]]:
    """Centres after some steps; the first centres are the means of rows dealt by key modulo k."""
    first = df.groupBy(F.pmod(F.col(key), F.lit(k)).alias("cluster"))
    width = df.select(F.max(F.size(vector))).first()[0]
    found = first.agg(*[F.avg(F.element_at(vector, i + 1)).alias(f"c{i}") for i in range(width)]).orderBy("cluster").collect()
    centres = [[float(r[f"c{i}"]) for i in range(width)] for r in found]
    for _ in range(rounds):
        new = {r.cluster: list(r.centre) for r in k_means_step(df, vector, centres).collect()}  # k rows
        moved = [new.get(i, c) for i, c in enumerate(centres)]
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _leader(rows: np.ndarray, eps: float, ratio: float | None, nearest_member: bool) -> list[int]:
    centres: list[np.ndarray] = []
    sizes: list[int] = []
    members: list[list[np.ndarray]] = []
    out = []
    for x in rows:
        if nearest_member:
            d = [min(np.linalg.norm(x - m) for m in group) for group in members]
        else:
            d = [np.linalg.norm(x - c) for c in centres]
        order = np.argsort(d, kind="stable")
        ok = len(order) and d[order[0]] < eps
        if ok and ratio is not None and len(order) > 1:
            ok = d[order[0]] < ratio * d[order[1]]
        if ok:
            c = int(order[0])
            sizes[c] += 1
            centres[c] = centres[c] + (x - centres[c]) / sizes[c]
            members[c].append(x)
        else:
            c = len(centres)
            centres.append(x.copy())
            sizes.append(1)
            members.append([x])
        out.append(c)
    return out


def leader(df: DataFrame, group: str, key: str, vector: str, eps: float, ratio: float | None = None, nearest_member: bool = False) -> DataFrame:
    """(group, key, cluster): each row joins the nearest cluster closer than `eps`, or begins one.

    Rows go in order of the key; `ratio` also asks that the second nearest be
    farther by that factor; distances are to centres, or to the nearest member.
    The order makes a group sequential; groups run apart.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        found = _leader(np.array(pdf[vector].tolist(), float), eps, ratio, nearest_member)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": found})

    schema = f"{group} {df.schema[group].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, cluster int"
    return df.select(group, key, vector).groupBy(group).applyInPandas(run, schema)


def spheres(rows: np.ndarray, radius: float, shrink: float = 0.9, least: float = 1e-3) -> list[int]:
    """FOREL: a sphere of cosine distance moves to the mean of what it holds, until it rests; then the rest."""
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    out, left, number = np.full(len(rows), -1), list(range(len(rows))), 0
    while left:
        centre, r = unit[left[0]], radius
        held = [left[0]]
        for _ in range(100):
            held = [i for i in left if 1 - unit[i] @ centre <= r]
            if not held:
                held = [left[0]]
            new = unit[held].mean(axis=0)
            new = new / max(np.linalg.norm(new), 1e-12)
            if np.linalg.norm(new - centre) < 1e-9 or r < least:
                break
            centre, r = new, max(r * shrink, least) if r > radius * 0.5 else r
        out[held] = number
        number += 1
        left = [i for i in left if out[i] < 0]
    return out.tolist()


def strong_dimensions(df: DataFrame, key: str, vector: str, top: int, popular: float = 0.1) -> DataFrame:
    """(key, dim): each row's `top` largest |components|, without dimensions that too many rows share."""
    ranked = F.slice(F.sort_array(F.transform(vector, lambda v, i: F.struct((-F.abs(v)).alias("m"), i.alias("dim")))), 1, top)
    long = df.select(key, F.explode(F.transform(ranked, lambda x: x["dim"])).alias("dim"))
    counts = long.groupBy("dim").agg(F.count("*").alias("n")).crossJoin(F.broadcast(df.agg(F.count("*").alias("all"))))  # one row
    return long.join(counts.where(F.col("n") < popular * F.col("all")).select("dim"), "dim")


def shared_components(links: DataFrame, key: str, dim: str) -> DataFrame:
    """(key, component): smallest key reachable over shared dimensions, however long the way.

    Each key is linked to the smallest one of its dimension, so no pairs of rows are made.
    """
    least = links.groupBy(dim).agg(F.min(key).alias("_m"))
    edges = links.join(least, dim).select(F.col(key).alias("a"), F.col("_m").alias("b"))
    found = connected(edges)
    return links.select(key).distinct().join(found.select(F.col("node").alias(key), "component"), key, "left").select(
        key, F.coalesce("component", key).alias("component")
    )


def class_similarity(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(one, other, similarity): mean cosine over all pairs of rows of two classes.

    By bilinearity it is the inner product of the classes' mean unit vectors:
    no pair of rows is made.
    """
    unit = df.where(V.norm(F.col(vector)) > 0).select(label, F.transform(vector, lambda v: v / V.norm(F.col(vector))).alias("u"))
    long = unit.select(label, F.posexplode("u").alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("m"))
    a, b = long.alias("a"), long.alias("b")
    pairs = a.join(b, F.col("a.i") == F.col("b.i"))
    return pairs.groupBy(F.col(f"a.{label}").alias("one"), F.col(f"b.{label}").alias("other")).agg(F.sum(F.col("a.m") * F.col("b.m")).alias("similarity"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
