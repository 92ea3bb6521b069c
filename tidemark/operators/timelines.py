"""Events of a user in time: the last one before, sessions, windows and runs of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import OrderedGroups


def last_before(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    left: Column,
    right: Column,
    prefix: str,
    **limits,
) -> DataFrame:
    """As-of join in one table: each ``left`` row with the last ``right`` row before it.

    The two kinds of rows go through one shuffle and one sort. The ``right`` row's order
    columns are added as ``{prefix}{name}``, null where no such row comes first. Of equal
    times, the later order columns say which row is first.
    """
    rows = df.where(left | right)
    ordered = OrderedGroups(rows, keys, order, **limits)
    found = ordered.running(_last=("max", F.when(right, F.struct(*order)))).df()
    return found.where(left).select(
        *df.columns, *[F.col(f"_last.{o}").alias(f"{prefix}{o}") for o in order]
    )


def sessions(
    df: DataFrame,
    key: str,
    time: str,
    gap_minutes: int,
    sums: dict[str, Column],
) -> DataFrame:
    """Sessions that end ``gap_minutes`` after their last event.

    Two events in one clock slot as long as the gap are always in one session, so the
    events are first summed up per slot. A busy user then has at most one row per slot
    of the calendar, and only those are ordered and merged.
    """
    slots = (
        df.groupBy(key, F.window(time, f"{gap_minutes} minutes").alias("_slot"))
        .agg(
            F.min(time).alias("_from"),
            F.max(time).alias("_to"),
            *[c.alias(n) for n, c in sums.items()],
        )
        .drop("_slot")
    )
    length = F.timestamp_diff("MICROSECOND", F.col("_from"), F.col("_to"))
    seconds = (length / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)") + F.lit(60 * gap_minutes)
    session = F.session_window("_from", F.make_interval(secs=seconds)).alias("_session")
    merged = slots.groupBy(key, session).agg(*[F.sum(n).alias(n) for n in sums])
    return merged.select(
        key,
        F.col("_session.start").alias("session_start"),
        F.col("_session.end").alias("session_end"),
        *sums,
    )


def hop_windows(
    df: DataFrame, keys: list[str], time: str, length_hours: int, hop_hours: int, sums: dict[str, Column]
) -> DataFrame:
    """Overlapping windows, put together from sums per hop.

    Spark copies each event into every window it falls in. Here events are summed per hop
    and only the sums are copied. The length is to be a multiple of the hop.
    """
    if hop_hours <= 0 or length_hours % hop_hours:
        raise ValueError("the length is to be a multiple of the hop")
    hops = df.groupBy(*keys, F.window(time, f"{hop_hours} hours").alias("_hop")).agg(
        *[c.alias(n) for n, c in sums.items()]
    )
    window = F.window("_start", f"{length_hours} hours", f"{hop_hours} hours").alias("_window")
    return (
        hops.withColumn("_start", F.col("_hop.start"))
        .groupBy(*keys, window)
        .agg(*[F.sum(n).alias(n) for n in sums])
        .select(
            *keys,
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            *sums,
        )
    )


def consecutive_days(df: DataFrame, key: str, time: str) -> DataFrame:
    """Runs of days in a row on which a key has events.

    Events are brought down to distinct days first, so a key has no more rows than the
    calendar has days.
    """
    days = df.select(key, F.to_date(time).alias("_day")).distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_day"))
    return (
        days.withColumn("_run", F.date_sub("_day", nth))
        .groupBy(key, "_run")
        .agg(
            F.min("_day").alias("first_day"),
            F.max("_day").alias("last_day"),
            F.count(F.lit(1)).alias("days"),
        )
        .drop("_run")
    )
