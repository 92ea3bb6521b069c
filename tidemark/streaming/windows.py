"""Sums over time windows and sessions of a stream, given out once they are final."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(sums: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in sums.items()]


def window_sums(
    events: DataFrame,
    keys: list[str],
    time: str,
    length: str,
    sums: dict[str, Column],
    hop: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """Tumbling windows, or overlapping ones every ``hop``. Sums are combined before the shuffle."""
    window = F.window(time, length, hop).alias("_window")
    out = events.withWatermark(time, delay).groupBy(window, *keys).agg(*_named(sums))
    return out.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *keys, *sums
    )


def session_sums(
    events: DataFrame, key: str, time: str, gap: str, sums: dict[str, Column], delay: str = "10 minutes"
) -> DataFrame:
    """Sessions that end ``gap`` after their last event.

    ``tidemark.prepare`` has sessions merged in the map tasks as well, which brings a busy
    user's events down to a few sessions before the shuffle.
    """
    session = F.session_window(time, gap).alias("_session")
    out = events.withWatermark(time, delay).groupBy(key, session).agg(*_named(sums))
    return out.select(
        key, F.col("_session.start").alias("session_start"), F.col("_session.end").alias("session_end"), *sums
    )
