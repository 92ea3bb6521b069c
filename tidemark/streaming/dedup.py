"""Repeats in a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_within(events: DataFrame, keys: list[str], time: str, id_column: str, quiet: str, delay: str = "10 minutes") -> DataFrame:
    """Events with no event of the same ``keys`` in the ``quiet`` time before them.

    Time is measured from the last event, not from the last one given out: events that keep
    following each other within ``quiet``, or exactly that far apart, give one row, the first
    by time and ``id_column``. So the answer does not depend on how the input falls into
    micro-batches. In a stream a row comes out once the watermark, ``delay`` behind the latest
    event, has passed the end of its run, and only rows later than that are left out. Runs are
    merged in the map tasks.
    """
    if events.isStreaming:
        events = events.withWatermark(time, delay)
    run = F.session_window(time, quiet).alias("_run")
    first = F.min(F.struct(time, id_column)).alias("_first")
    return events.groupBy(*keys, run).agg(first).select(*keys, f"_first.{time}", f"_first.{id_column}")
