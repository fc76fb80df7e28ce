"""Quantisation: borders of features, bins of rows.

Borders come from the counts of distinct values of a feature, so the search
sees a feature's values and not its rows.  It asks only which value stands at a
given rank: of features with few distinct values (`local_values`) one task
answers from all of them, of others a table of cumulative counts does, a round
of questions at a time.  Both give the same borders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.lineage import cut


class GreedyBorders:
    """The greedy search for at most bins - 1 borders of one feature, a question at a time.

    A border is the last row of a value, a segment runs from one border to the
    next.  It can be split before or after its median value; a border at row r
    of the segment (a, b) is worth ln(b - r) + ln(r - a), which has to be
    positive.  The best split of all is taken each time, the first on ties.

    `asks` are the ranks whose values the search waits for; `answer` takes, for
    each, (value, its last row, the value before, that one's last row or -1).
    """

    def __init__(self, rows: int, bins: int):
        self.bins, self.edges = bins, [0, rows]
        self.found: list[tuple[float, int] | None] = [None] if rows else []
        self.value: dict[int, float] = {}

    def asks(self) -> list[int]:
        return [a + (b - a) // 2 for a, b, f in zip(self.edges, self.edges[1:], self.found) if f is None]

    def answer(self, replies: dict[int, tuple[float, int, float | None, int]]) -> None:
        for i, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            if self.found and self.found[i] is None:
                value, last, lower, before = replies[a + (b - a) // 2]
                self.value |= {last: value, before: lower}
                places = [r for r in (before, last) if a < r < b - 1 or (r == before and a < r < b)]
                worth = [(float(np.log(b - r) + np.log(r - a)), r) for r in places]
                self.found[i] = max(worth, key=lambda x: (x[0], -x[1]), default=(0.0, -1))
        while self.found and None not in self.found and len(self.edges) - 2 < self.bins - 1:
            k = max(range(len(self.found)), key=lambda i: (self.found[i][0], -i))
            worth, place = self.found[k]
            if worth <= 0:
                break
            self.edges.insert(k + 1, place)
            self.found[k : k + 1] = [None, None]
        if None in self.found and len(self.edges) - 2 >= self.bins - 1:
            self.found = [(0.0, -1)] * len(self.found)

    def borders(self) -> list[float]:
        return [float(self.value[r]) for r in self.edges[1:-1]]


def log_sum_borders(values: Sequence[float], counts: Sequence[int], bins: int) -> list[float]:
    """At most bins - 1 borders of one feature, from its distinct values, ascending, and their counts."""
    v = np.asarray(values, float)
    last = np.cumsum(np.asarray(counts, np.int64)) - 1  # last row of each value
    search = GreedyBorders(int(last[-1]) + 1 if len(last) else 0, bins)

    def reply(rank: int) -> tuple[float, int, float | None, int]:
        i = int(np.searchsorted(last, rank))
        return (v[i], int(last[i]), v[i - 1], int(last[i - 1])) if i else (v[0], int(last[0]), None, -1)

    while asks := search.asks() if bins > 1 else []:
        search.answer({r: reply(r) for r in asks})
    return search.borders()


@dataclass
class Grid:
    """Sorted borders of each feature; `one_hot` features have levels in place of borders."""

    borders: list[list[float]]
    one_hot: set[int] = field(default_factory=set)

    def bins(self, features: Column) -> Column:
        """Bin of each feature: borders below the value; a one-hot feature's level from 1, 0 for others."""
        out = []
        for i, row in enumerate(self.borders):
            x = F.element_at(features, i + 1)
            edges = F.array(*[F.lit(float(b)) for b in row]) if row else F.array().cast("array<double>")
            if i in self.one_hot:
                out.append(F.coalesce(F.array_position(edges, x), F.lit(0)).cast("int"))
            else:
                out.append(F.coalesce(_above(x, row), F.lit(0)))
        return F.array(*out) if out else F.array().cast("array<int>")

    def conditions(self) -> list[tuple[int, int, float]]:
        """All binary features as (feature, bin, border): the value is above the border."""
        return [(f, b, x) for f, row in enumerate(self.borders) for b, x in enumerate(row)]

    def to_text(self) -> str:
        """A line a feature, borders between tabs."""
        return "\n".join("\t".join(repr(b) for b in row) for row in self.borders)

    @staticmethod
    def from_text(text: str) -> Grid:
        return Grid([[float(b) for b in line.split("\t") if b] for line in text.split("\n")])


def _above(x: Column, borders: Sequence[float]) -> Column:
    out = F.lit(0)
    for b in borders:
        out = out + F.when((x > F.lit(float(b))) & ~F.isnan(x), 1).otherwise(0)
    return out


def value_counts(df: DataFrame, features: str) -> DataFrame:
    """(feature, value, n): distinct values of each feature and their rows."""
    long = df.select(F.posexplode(features).alias("feature", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("feature", "value").agg(F.count("*").alias("n"))


def _ranked(counts: DataFrame) -> DataFrame:
    """(feature, value, before, last): of each distinct value the rows up to its first, and its last row, in its feature.

    Values are dealt over ranges and summed a range at a time, so no task holds a feature.
    """
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, "feature", "value").withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt)  # dealt twice, ranges could be cut at other values
    sums = sorted((r["feature"], r["_part"], r["n"]) for r in dealt.groupBy("feature", "_part").agg(F.sum("n").alias("n")).collect())
    bases, seen = [], {}
    for feature, part, n in sums:
        bases.append((feature, part, seen.get(feature, 0)))
        seen[feature] = seen.get(feature, 0) + n
    base = spark.createDataFrame(bases, "feature int, _part int, _base long")  # a row a feature and range
    up_to = F.sum("n").over(Window.partitionBy("feature", "_part").orderBy("value"))
    out = dealt.withColumn("_up", up_to).join(F.broadcast(base), ["feature", "_part"])
    return cut(out.select("feature", "value", (F.col("_base") + F.col("_up") - F.col("n")).alias("before"), (F.col("_base") + F.col("_up") - 1).alias("last")))


def _wide_borders(counts: DataFrame, bins: int) -> list[tuple[int, float]]:
    """(feature, border) of features with many distinct values: a job a round answers all features' questions."""
    ranked = _ranked(counts)
    rows = {r.feature: r.n for r in ranked.groupBy("feature").agg((F.max("last") + 1).alias("n")).collect()}
    searches = {f: GreedyBorders(n, bins) for f, n in rows.items()}
    while bins > 1 and any((asks := {f: s.asks() for f, s in searches.items()}).values()):
        # of the value that holds a rank, and of the one before it: (value, last row), at most two values a question
        tests = [
            (F.col("feature") == f) & (F.col("before") <= r) & (F.col("last") >= r) for f, ranks in asks.items() for r in ranks
        ]
        held = {(r.feature, r.before): r for r in ranked.where(reduce(or_, tests)).collect()}
        ends = [(F.col("feature") == f) & (F.col("last") == before - 1) for f, before in held if before]
        lower = {(r.feature, r.last): r.value for r in ranked.where(reduce(or_, ends)).collect()} if ends else {}
        for f, ranks in asks.items():
            replies = {}
            for rank in ranks:
                r = next(x for (g, _), x in held.items() if g == f and x.before <= rank <= x.last)
                replies[rank] = (r.value, r.last, lower.get((f, r.before - 1)), r.before - 1)
            if ranks:
                searches[f].answer(replies)
    return [(f, b) for f, s in searches.items() for b in s.borders()]


def fit(df: DataFrame, features: str, bins: int = 32, local_values: int = 100_000) -> Grid:
    """A grid over all features: greedy borders, each feature by itself.

    Borders that part the rows as an earlier feature's border does are left out.
    """

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        found = log_sum_borders(pdf["value"].to_numpy(), pdf["n"].to_numpy(), bins)
        return pd.DataFrame({"feature": int(pdf["feature"].iloc[0]), "border": found})

    counts = cut(value_counts(df, features))
    sizes = {r.feature: r.d for r in counts.groupBy("feature").agg(F.count("*").alias("d")).collect()}  # a row a feature
    wide = [f for f, d in sizes.items() if d > local_values]
    found = [] if len(wide) == len(sizes) else [
        (r.feature, r.border)
        for r in counts.where(~F.col("feature").isin(wide)).groupBy("feature").applyInPandas(borders, "feature int, border double").collect()
    ]  # bins a feature
    if wide:
        found += _wide_borders(counts.where(F.col("feature").isin(wide)), bins)
    width = df.agg(F.max(F.size(features)).alias("w")).first().w or 0
    rows: list[list[float]] = [[] for _ in range(width)]
    for feature, border in found:
        rows[feature].append(border)
    grid = Grid([sorted(r) for r in rows])
    return distinct_partitions(df, features, grid)


def distinct_partitions(df: DataFrame, features: str, grid: Grid, key: str = "row_id") -> Grid:
    """The grid without borders that part the rows as an earlier border does.

    Each border's partition is named by the sum of its rows' hashes, one
    aggregation for all borders.
    """
    if key not in df.columns:
        return grid
    sums = []
    for i, (f, _, b) in enumerate(grid.conditions()):
        inside = F.element_at(features, f + 1) > F.lit(b)
        sums.append(F.sum(F.when(inside, F.xxhash64(key).cast("decimal(38,0)")).otherwise(0)).alias(f"c{i}"))
    if not sums:
        return grid
    row, seen, out = df.agg(*sums).first(), set(), [[] for _ in grid.borders]
    for i, (f, _, b) in enumerate(grid.conditions()):
        name = row[f"c{i}"]
        if name not in seen:
            seen.add(name)
            out[f].append(b)
    return Grid(out, grid.one_hot)


def one_hot(df: DataFrame, features: str, feature: int, most: int = 255) -> list[float]:
    """The levels of a categorical feature, ascending; more than `most` are refused."""
    rows = df.select(F.element_at(features, feature + 1).alias("v")).distinct().orderBy("v").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"feature {feature} has more than {most} levels")
    return [r.v for r in rows]


def command_line_borders(values: Sequence[float], counts: Sequence[int], bins: int = 32) -> list[float]:
    """The variant of the command line: each border one distinct value lower, the last one dropped."""
    v = sorted(set(values))
    found = log_sum_borders(values, counts, bins)
    lower = [v[v.index(b) - 1] if v.index(b) else b for b in found]
    return sorted(set(lower[:-1]))
