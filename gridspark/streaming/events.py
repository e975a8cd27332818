"""Streams of observations: windowed means and counts with watermarks; late rows beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_means(stream: DataFrame, time: str, value: str, by: list[str], width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean and count of each window and key; works on streams and on tables alike."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(w.alias("w"), *by).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("w.start").alias("start"), *by, "mean", "n")


def running_eight_hour_means(stream: DataFrame, time: str, value: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Eight-hour windows that start each hour, over all values; a window needs values in it."""
    return window_means(stream, time, value, by, "8 hours", "1 hour", late)


def sessions(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of events of one key that are never a gap apart."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def daily_maximum_of_means(stream: DataFrame, time: str, value: str, by: list[str], late: str = "1 hour", least: int = 6) -> DataFrame:
    """The day's largest mean of eight hours that begin in it: day, by, maximum.

    Three states are chained: an hour's mean, the mean of eight hours' means (of which
    ``least`` must be there), and the day's maximum.  Each gives its result when the
    watermark has passed its end, so a row may come late by ``late``; later rows are
    dropped.  Works on streams (append mode) and on tables alike.
    """
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    hours = rows.groupBy(F.window(time, "1 hour").alias("w"), *by).agg(F.avg(value).alias("v__"))
    means = hours.groupBy(F.window("w", "8 hours", "1 hour").alias("w"), *by).agg(F.avg("v__").alias("m__"), F.count("v__").alias("n__"))
    # a window's time is its end: those of a day's eight hours end from 8 o'clock on to 7 of the next day
    days = means.filter(F.col("n__") >= least).groupBy(F.window("w", "1 day", startTime="7 hours 30 minutes").alias("w"), *by).agg(F.max("m__").alias("maximum"))
    return days.select((F.col("w.start") - F.expr("INTERVAL 450 MINUTES")).cast("date").alias("day"), *by, "maximum")
