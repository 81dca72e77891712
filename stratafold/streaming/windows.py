"""Streaming operators: windows with watermarks, sessions, running moments, and the same windows in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, value: str, key: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count, mean and extremes per window and key; with ``late`` the state of windows older than that is dropped (on a stream)."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.window(time, width, slide) if slide else F.window(time, width), key)
    out = out.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "mean", "min", "max")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Events of a key closer than the gap make one session."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def running_moments(events: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and sample variance of a key so far, kept as mergeable moments in streaming state; an updated row per key and batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(k, frames, state: GroupState):
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for frame in frames:
            x = frame["value"].dropna().to_numpy(dtype=float)
            if len(x):
                m, own = len(x), float(x.mean())
                gap, total = own - mean, n + m
                mean, m2, n = mean + gap * m / total, m2 + float(((x - own) ** 2).sum()) + gap * gap * n * m / total, total
        state.update((n, mean, m2))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "mean": [mean], "variance": [m2 / (n - 1) if n > 1 else None]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, n long, mean double, variance double", "n long, mean double, m2 double", "update", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, path: str) -> DataFrame:
    """A folder of Parquet files as a stream with the schema of ``events``."""
    return events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
