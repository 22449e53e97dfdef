"""Frames as they arrive: windowed statistics with a bound on lateness, and thresholds carried on from frame to frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(frames: DataFrame, every: str, slide: str | None = None, late: str = "0 seconds", at: str = "ts", by: tuple = ("channel",), value: str = "value") -> DataFrame:
    """(start, end, by, n, mean) of tumbling windows, or sliding ones with ``slide``.

    Rows that come more than ``late`` after the newest one are left out once their window is closed; null times are.
    """
    w = F.window(at, every, slide) if slide else F.window(at, every)
    g = frames.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean")


def sessions(frames: DataFrame, gap: str, late: str = "0 seconds", at: str = "ts", by: tuple = ("channel",)) -> DataFrame:
    """(start, end, by, n) of sessions, runs of rows no more than ``gap`` apart."""
    g = frames.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def carried_thresholds(frames: DataFrame, max_jump: float = 1.5) -> DataFrame:
    """(channel, frame, thr, used) as :func:`voxloom.operators.intensity.carry_forward` gives them, batch by batch.

    ``frames``: channel string, frame int, thr double. Frames of a channel come in order from batch
    to batch (within one they are sorted); the state of a channel is its last good threshold.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        good = state.get[0] if state.exists else None
        rows = pd.concat(parts).sort_values(["frame", "thr"], na_position="first")
        used = []
        for thr in rows["thr"].tolist():
            if thr == thr and thr is not None and (good is None or (good != 0 and abs(thr / good - 1) <= max_jump - 1)):
                good = thr
            used.append(good)
        if good is not None:
            state.update((good,))
        yield pd.DataFrame({"channel": key[0], "frame": rows["frame"].astype("int32"), "thr": rows["thr"], "used": pd.Series(used, rows.index, "float64")})

    return frames.groupBy("channel").applyInPandasWithState(run, "channel string, frame int, thr double, used double", "good double", "append", "NoTimeout")
