"""Event operators on streams: session windows, decayed user states, return-time predictions.

Every state has a time to live, so what is kept is bounded by the users seen in
that time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A user who stays away for so many hours has gone.
CHURN_HOURS = 14 * 24.0


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour", value: str | None = None) -> DataFrame:
    """(user, start, end, n_events[, total]) of each session, once the watermark has passed it."""
    rows = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user)
    sums = [F.count("*").alias("n_events")] + ([F.sum(value).alias("total")] if value else [])
    out = rows.agg(*sums)
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *out.columns[2:])


def rates(events: DataFrame, ts: str, key: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events of each key in tumbling or sliding windows."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def update(intensity: float, gap: float, gain: float, decay: float, timed: bool) -> float:
    """A user's decayed intensity after an event; without `timed` every gap counts as 1."""
    return math.exp(-decay * (gap if timed else 1.0)) * intensity + gain


def online_intensity(
    events: DataFrame, user: str, item: str, ts: str, hours: str, affinity: Callable[[object, object], float], base: float = 0.1,
    decay: float = 0.1, timed: bool = False, look_ahead: bool = True, ttl_hours: float = CHURN_HOURS, late: str = "1 hour",
) -> DataFrame:
    """(user, item, hours, intensity, expected_gap) of each event, from the user's decayed state.

    With `look_ahead` the intensity is that after the event, else before.  The
    state is (time, sum) a user and goes once the watermark is `ttl_hours` past
    the user's last event.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, total = state.get if state.exists else (None, 0.0)
        newest = state.getCurrentWatermarkMs()
        for pdf in batches:
            seen = pdf[ts].dropna()
            newest = max(newest, int(seen.max().timestamp() * 1000)) if len(seen) else newest
            out = []
            for i, t in sorted(zip(pdf[item], pdf[hours]), key=lambda x: x[1]):
                before = total
                total = update(total, 0.0 if last is None else t - last, affinity(key[0], i), decay, timed)
                last = t
                lam = max(base + (total if look_ahead else before), 1e-9)
                out.append((key[0], i, t, lam, 1.0 / lam))
            if out:
                yield pd.DataFrame(out, columns=[user, item, hours, "intensity", "expected_gap"])
        state.update((last, total))
        state.setTimeoutTimestamp(newest + int(ttl_hours * 3_600_000))

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"{user} {kinds[user]}, {item} {kinds[item]}, {hours} double, intensity double, expected_gap double"
    rows = events.withWatermark(ts, late).select(user, item, ts, F.col(hours).cast("double").alias(hours))
    return rows.groupBy(user).applyInPandasWithState(
        step, schema, "last double, total double", "append", GroupStateTimeout.EventTimeTimeout
    )


def batch_intensity(events: DataFrame, user: str, order: list[str], gain: F.Column | None = None, base: float = 0.1, decay: float = 0.1) -> DataFrame:
    """The same state on a table, as a fold over each user's events in order."""
    gain = F.lit(1.0) if gain is None else gain
    rows = events.select(user, F.struct(*order, gain.alias("_gain")).alias("e"))
    lists = rows.groupBy(user).agg(F.sort_array(F.collect_list("e")).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: F.exp(F.lit(-decay)) * a + x["_gain"])
    return lists.select(user, (total + base).alias("intensity"), F.size("e").alias("n_events"))


def interval_probability(intensity: F.Column, start: F.Column, end: F.Column) -> F.Column:
    """Probability that an exponential gap ends between two times."""
    return F.exp(-intensity * start) - F.exp(-intensity * end)


def gamma_interval_probability(intensity: F.Column, start: F.Column, end: F.Column) -> F.Column:
    """The same for a Gamma gap of shape 2."""

    def tail(t: F.Column) -> F.Column:
        return F.exp(-intensity * t) * (1 + intensity * t)

    return tail(start) - tail(end)


def next_day(deltas: DataFrame, user: str, delta_hours: str) -> DataFrame:
    """(user, days, hour_gap): days to the next visit as 1 / rate, and the mean gap of users within a day."""
    means = deltas.where(F.col(delta_hours).between(0.5, CHURN_HOURS)).groupBy(user).agg(
        F.avg(delta_hours).alias("mean"), F.avg(F.when(F.col(delta_hours) <= 24, F.col(delta_hours))).alias("short")
    )
    overall = deltas.where(F.col(delta_hours) <= 24).agg(F.avg(delta_hours).alias("all"))
    out = means.crossJoin(F.broadcast(overall))  # one row
    return out.select(user, F.greatest(F.round(F.col("mean") / 24), F.lit(0.0)).alias("days"), F.coalesce("short", "all").alias("hour_gap"))


def listen(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """A listener on a stream: called with each batch; restarts go on from the checkpoint."""
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def json_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of JSON objects, a line each, from files that come into a folder."""
    text = spark.readStream.text(folder)
    return text.select(F.from_json("value", schema).alias("v")).select("v.*").dropna("all")
