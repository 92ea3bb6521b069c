"""Streams joined to tables and to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_lookup(events: DataFrame, lookup: DataFrame, key: str, lookup_key: str) -> DataFrame:
    """Left join of a stream to a table. It keeps no state; Spark broadcasts the table while
    it is small, and no key of the stream then moves at all."""
    return events.join(lookup, F.col(key) == F.col(lookup_key), "left").drop(lookup_key)


def _bucket(time: str, length: str) -> Column:
    """The number of the stretch of ``length`` that a time falls in, counted from 1970."""
    width = F.expr(f"unix_micros(timestamp_seconds(0) + interval {length})")
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / width)


def matched_within(
    left: DataFrame, right: DataFrame, key: str, time: str, id_column: str, within: str, delay: str = "10 minutes"
) -> DataFrame:
    """Rows of one stream with a row of the other by the same key up to ``within`` before.

    A semi join: each row comes out once, however many rows it matches, and both sides'
    state is dropped when the watermarks pass. Time is cut into stretches of ``within``, and
    rows meet by key and stretch, the right side's in its own and the next one; so a busy
    key's rows spread over its stretches, by a rule that is the same at every start.
    """
    left = left.withColumn("_stretch", _bucket(time, within)).withWatermark(time, delay)
    own = _bucket(time, within)
    right = right.select(key, time, id_column).withColumn("_stretch", F.explode(F.array(own, own + 1)))
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in right.columns}).withWatermark(f"_r_{time}", delay)
    here, there = F.col(time), F.col(f"_r_{time}")
    condition = (
        (F.col(key) == F.col(f"_r_{key}"))
        & (F.col("_stretch") == F.col("_r__stretch"))
        & (there >= here - F.expr(f"interval {within}"))
        & (there <= here)
        & ((there < here) | (F.col(f"_r_{id_column}") < F.col(id_column)))
    )
    return left.join(right, condition, "left_semi").drop("_stretch")
