"""The same windowed operators for batch frames and streams of events (ts, user_id, event_type, value, props)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """Event times as instants (they are read as UTC), with a watermark if ``late`` is given."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if late else e


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; ``late`` sets the watermark of a stream."""
    e = _timed(events, late)
    out = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours", late: str | None = None) -> DataFrame:
    e = _timed(events, late)
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions per user: events closer than ``gap``."""
    e = _timed(events, late)
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.select("user_id", "first_ts", "last_ts", "n")


def funnel(events: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """Users who reached each step after the step before it."""
    first = events.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == steps[0], F.col("ts"))).alias("t"))
    out = None
    for i, s in enumerate(steps):
        reached = first.filter("t is not null")
        row = reached.agg(F.lit(i).alias("step"), F.lit(s).alias("event_type"), F.count("*").alias("users"))
        out = row if out is None else out.unionByName(row)
        if i + 1 < len(steps):
            nxt = events.filter(F.col("event_type") == steps[i + 1]).select("user_id", "ts")
            first = reached.join(nxt, "user_id").filter(F.col("ts") > F.col("t")).groupBy("user_id").agg(F.min("ts").alias("t"))
    return out


DRIFT = "key string, n long, sum double, high double, alert boolean"


def drift(events: DataFrame, mean: float, allowance: float, threshold: float) -> DataFrame:
    """Running upward CUSUM of ``value`` per event type over a stream; one row per type and trigger.

    Within a trigger, rows are taken in order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, total, high = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for v in rows["value"].dropna():
            n, total, high = n + 1, total + float(v), max(0.0, high + float(v) - mean - allowance)
        state.update((n, total, high))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "sum": [total], "high": [round(high, 6)], "alert": [high >= threshold]})

    return events.groupBy("event_type").applyInPandasWithState(step, DRIFT, "n long, sum double, high double", "update", "NoTimeout")


def gaps(events: DataFrame) -> DataFrame:
    """Seconds since the user's previous event, for batch frames."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", "user_id", (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))).alias("gap"))
