"""Aggregates over sliding, tumbling and landmark windows of a time column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, ts: str, seconds: int, *aggs: Column, slide: int | None = None, keys: Sequence[str] = (), start: int = 0) -> DataFrame:
    """(window_start, window_end, keys.., aggs..): half-open windows of so many seconds, a new one every ``slide`` (default: as long as they are)."""
    w = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds", f"{slide or seconds} seconds", f"{start} seconds")
    out = df.groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def landmark(df: DataFrame, *aggs: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Over the whole history."""
    return df.groupBy(*keys).agg(*aggs)


def numbered_windows(df: DataFrame, ts: str, seconds: int, *aggs: Column, slide: int | None = None, keys: Sequence[str] = (), origin: int = 0) -> DataFrame:
    """(wid, window_start, window_end, keys.., aggs..): windows with both ends included in their numbering.

    A row at t belongs to the numbers floor((t - origin) / slide) + 1 up to
    floor((t + seconds - origin) / slide) + 1, one more than in half-open
    windows; number k is labelled [origin + k * slide, + seconds].
    """
    step = (slide or seconds) * 1_000_000
    t = F.unix_micros(F.col(ts).cast("timestamp")) - origin * 1_000_000
    first, last = F.floor(t / step) + 1, F.floor((t + seconds * 1_000_000) / step) + 1
    out = df.withColumn("wid", F.explode(F.sequence(first, last))).groupBy("wid", *keys).agg(*aggs)
    begin = F.timestamp_micros(F.lit(origin * 1_000_000) + F.col("wid") * step)
    return out.select("wid", begin.alias("window_start"), (begin + F.make_interval(secs=F.lit(seconds))).alias("window_end"), *[c for c in out.columns if c != "wid"])
