"""Ordered analytics: ranks, running encodings, runs, sessions, as-of values.

All windows are partitioned by a key of the data; ties are broken by columns
that the caller names, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def argsort(df: DataFrame, group: str, value: str, tie: str, out: str = "place") -> DataFrame:
    """Place of each row in its group by value, from 0."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(group).orderBy(value, tie)) - 1).cast("long"))


def average_ranks(df: DataFrame, group: str, value: str, out: str = "avg_rank") -> DataFrame:
    """Rank from 0, where the rows of a tie [i, j) share i + (j - i) / 2."""
    block = Window.partitionBy(group, value)
    rank = F.rank().over(Window.partitionBy(group).orderBy(value)) - 1
    return df.withColumn(out, rank + 0.5 * F.count("*").over(block))


def running_rate(df: DataFrame, key: str, order: list[str], hit: Column, out: str = "rate") -> DataFrame:
    """(hits + 1) / (rows + 2) of the earlier rows of a key."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    hits = F.coalesce(F.sum(F.when(hit, 1).otherwise(0)).over(before), F.lit(0))
    return df.withColumn(out, (hits + 1.0) / (F.count("*").over(before) + 2.0))


def running_multiplier(df: DataFrame, key: str, order: list[str], value: str, out: str = "multiplier") -> DataFrame:
    """(sum of value / mean + 1) / (n + 1) over the rows of a key up to each row; the mean is the table's."""
    mean = df.agg(F.avg(value).alias("_mean"))
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.col(value) / F.col("_mean")
    return (
        df.crossJoin(F.broadcast(mean))  # one row
        .withColumn(out, (F.sum(share).over(so_far) + 1) / (F.count("*").over(so_far) + 1))
        .drop("_mean")
    )


def rolling_volatility(df: DataFrame, key: str, order: list[str], value: str, rows: int = 30, out: str = "volatility") -> DataFrame:
    """Root of mean square minus squared mean over the last rows of a key."""
    last = Window.partitionBy(key).orderBy(*order).rowsBetween(-(rows - 1), 0)
    n = F.count("*").over(last)
    mean = F.sum(value).over(last) / n
    return df.withColumn(out, F.sqrt(F.greatest(F.sum(F.col(value) * F.col(value)).over(last) / n - mean * mean, F.lit(0.0))))


def previous_delta(df: DataFrame, keys: list[str], ts: str, tie: str, out: str = "delta") -> DataFrame:
    """Time since the previous event of the same keys; null for the first."""
    return df.withColumn(out, F.col(ts) - F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, tie)))


def runs(df: DataFrame, user: str, item: str, ts: str, tie: str, gap: float) -> DataFrame:
    """The events that begin a run: the user's first, another item, or a gap of more than `gap`.

    `delta` is the time since the user's previous event, of whatever run; -1 for the first.
    """
    along = Window.partitionBy(user).orderBy(ts, tie)
    since = F.col(ts) - F.lag(ts).over(along)
    seen = df.withColumn("_item", F.lag(item).over(along)).withColumn("_since", since)
    first = F.col("_since").isNull()
    begins = first | ~F.col(item).eqNullSafe(F.col("_item")) | (F.col("_since") > gap)
    return seen.where(begins).withColumn("delta", F.when(first, -1.0).otherwise(F.col("_since"))).drop("_item", "_since")


def sessions(df: DataFrame, user: str, ts: str, tie: str, gap: float, out: str = "session") -> DataFrame:
    """Number of each event's session of its user, from 1; a gap of more than `gap` begins another."""
    along = Window.partitionBy(user).orderBy(ts, tie)
    new = F.when(F.coalesce(F.col(ts) - F.lag(ts).over(along) > gap, F.lit(True)), 1).otherwise(0)
    marked = df.withColumn("_new", new)
    return marked.withColumn(out, F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def session_stats(df: DataFrame, user: str, ts: str, session: str = "session") -> DataFrame:
    """Events and length of each session."""
    return df.groupBy(user, session).agg(F.count("*").alias("n_events"), (F.max(ts) - F.min(ts)).alias("length"))


def sessions_per_unit(df: DataFrame, keys: list[str], ts: str, unit: float, eps: float = 1e-6) -> DataFrame:
    """Events per unit of time of each key from the table's first event on: n / ((last + unit - eps) / unit)."""
    start = df.agg(F.min(ts).alias("_start"))
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(ts).alias("_last")).crossJoin(F.broadcast(start))  # one row
    return by.select(*keys, "n", (F.col("n") / ((F.col("_last") - F.col("_start") + unit - eps) / unit)).alias("per_unit"))


def rate_error(df: DataFrame, keys: list[str], predicted: str, actual: str, order: list[str], most: float | None = None) -> DataFrame:
    """Mean |1 / predicted - 1 / actual| of each key, the prediction being the one made a row before.

    Rows with an actual gap of more than `most` are left out.
    """
    made = F.lag(predicted).over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.withColumn("_made", made).where(F.col("_made").isNotNull() & (F.col("_made") > 0) & (F.col(actual) > 0))
    if most is not None:
        rows = rows.where(F.col(actual) <= most)
    return rows.groupBy(*keys).agg(F.avg(F.abs(1 / F.col("_made") - 1 / F.col(actual))).alias("error"), F.count("*").alias("n"))


def quiet_hour(df: DataFrame, user: str, hour: Column) -> DataFrame:
    """Each user's first hour of the day with the fewest events, of all 24."""
    counts = df.groupBy(user, hour.cast("int").alias("hour")).agg(F.count("*").alias("n"))
    grid = counts.select(user).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    full = grid.join(counts, [user, "hour"], "left").fillna(0, ["n"])
    return full.groupBy(user).agg(F.min_by("hour", F.struct("n", "hour")).alias("quiet_hour"))


def transitions(df: DataFrame, user: str, query: str, ts: str, tie: str, gap: float) -> DataFrame:
    """Count of (previous, current) of a user's different consecutive values within a gap."""
    along = Window.partitionBy(user).orderBy(ts, tie)
    both = df.select(
        F.lag(query).over(along).alias("previous"), F.col(query).alias("current"), (F.col(ts) - F.lag(ts).over(along)).alias("since")
    ).where((F.col("since") < gap) & (F.col("previous") != F.col("current")))
    return both.groupBy("previous", "current").agg(F.count("*").alias("n"))


def as_of_next(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str, out: str) -> DataFrame:
    """`left` with the value of the first `right` row of the same keys at or after its time.

    Both sides are one sorted stream a key: one shuffle, no join of ranges.
    `right` has at most one row a key and time.
    """
    names = left.columns
    both = left.withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1)).unionByName(
        right.select(*by, F.col(ts), F.col(value).alias("_value"), F.lit(0).alias("_left")), allowMissingColumns=True
    )
    # backwards in time, so that the frame grows row by row; an exact hit comes before the left row
    passed = Window.partitionBy(*by).orderBy(F.desc(ts), F.asc("_left")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_value", ignorenulls=True).over(passed)).where("_left = 1").select(*names, out)


def top(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values, ties to the smaller."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def some(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """n values chosen by the hash of their text: the same for any partitioning."""
    hashed = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    return df.select(key).distinct().orderBy(hashed, key).limit(n)


def core(df: DataFrame, train: Column, user: str, item: str, rounds: int = 3) -> DataFrame:
    """Rows whose user and item each occur in both halves, repeated until nothing changes or `rounds`.

    One aggregation a side and round; semi-joins keep the rows.
    """
    now = df.withColumn("_train", train)
    for _ in range(rounds):
        for key in (user, item):
            both = now.groupBy(key).agg(F.max(F.col("_train").cast("int")).alias("a"), F.max((~F.col("_train")).cast("int")).alias("b"))
            now = now.join(both.where("a = 1 and b = 1").select(key), key, "left_semi")
    return now.drop("_train")
