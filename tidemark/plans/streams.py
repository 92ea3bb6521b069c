"""The event queries that run as streams. Each works through the whole table, with a delay
by which no row is late in whatever order the files are, and closes its stream, so that the last
windows and sessions come out as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import as_double, exact_sum, units
from tidemark.plans.events import (
    FIRST_EVENTS_SQL,
    HOURLY_EVENT_COUNTS_SQL,
    PURCHASES_SOON_AFTER_VIEW_SQL,
    SLIDING_EVENT_COUNTS_SQL,
    SQL_SESSIONS,
)
from tidemark.plans.registry import Query
from tidemark.sources import closable_stream, delay_for_all, stream, survey, table
from tidemark.streaming import (
    first_within,
    matched_within,
    run_to_table,
    running_counts,
    session_sums,
    window_sums,
    with_lookup,
)


def _sums() -> dict:
    return {"events": F.count(F.lit(1)), "total": exact_sum(units("value"))}


def _events(spark: SparkSession, data_dir: str, *columns: str) -> DataFrame:
    return stream(spark, data_dir, "events").select(*columns)


def _delay(spark: SparkSession, data_dir: str) -> str:
    return delay_for_all(spark, data_dir, "events")


def _closed(spark: SparkSession, data_dir: str, name: str, columns: list[str], build: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What ``build`` makes of the events and of the delay, run to its end."""
    delay, one_batch = survey(spark, data_dir, "events")
    events, close = closable_stream(spark, data_dir, "events", columns)
    return run_to_table(spark, build(events, delay), name, close=close, one_batch=one_batch)


def _plain(df: DataFrame, *times: str) -> DataFrame:
    """Times as the table holds them, without a zone, and money as doubles."""
    out = df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})
    return out.withColumn("total", as_double("total")) if "total" in df.columns else out


def stream_hourly_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    def sums(events: DataFrame, delay: str) -> DataFrame:
        return window_sums(events, ["event_type"], "ts", "1 hour", _sums(), delay=delay)

    return _plain(_closed(spark, data_dir, "hourly-counts", ["ts", "event_type", "value"], sums), "window_start", "window_end")


STREAM_HOURLY_COUNTS_SQL = f"select *, window_start + interval 1 hour as window_end from ({HOURLY_EVENT_COUNTS_SQL})"


def stream_sliding_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    def sums(events: DataFrame, delay: str) -> DataFrame:
        return window_sums(events, [], "ts", "2 hours", _sums(), hop="1 hour", delay=delay)

    return _plain(_closed(spark, data_dir, "sliding-counts", ["ts", "value"], sums), "window_start", "window_end")


def stream_sessions(spark: SparkSession, data_dir: str) -> DataFrame:
    def sums(events: DataFrame, delay: str) -> DataFrame:
        return session_sums(events, "user_id", "ts", "30 minutes", _sums(), delay=delay)

    return _plain(_closed(spark, data_dir, "sessions", ["user_id", "ts", "value"], sums), "session_start", "session_end")


def stream_first_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """Events that follow no other of the same user and type within ten minutes."""
    def firsts(events: DataFrame, delay: str) -> DataFrame:
        return first_within(events, ["user_id", "event_type"], "ts", "event_id", "10 minutes", delay)

    return _plain(_closed(spark, data_dir, "first-events", ["event_id", "ts", "user_id", "event_type"], firsts), "ts")


def stream_purchases_soon_after_view(spark: SparkSession, data_dir: str) -> DataFrame:
    """Purchases with a view by the same user in the two hours before, from two streams."""
    events = _events(spark, data_dir, "event_id", "ts", "user_id", "event_type")
    again = _events(spark, data_dir, "event_id", "ts", "user_id", "event_type")
    kind = F.col("event_type")
    out = matched_within(
        events.where(kind == "purchase").drop("event_type"),
        again.where(kind == "view").drop("event_type"),
        "user_id",
        "ts",
        "event_id",
        "2 hours",
        _delay(spark, data_dir),
    )
    return _plain(run_to_table(spark, out, "soon-after-view"), "ts")


def stream_events_with_segment(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each event with the market segment of the customer of the same number, if any."""
    events = _events(spark, data_dir, "event_id", "user_id", "event_type")
    customers = table(spark, data_dir, "customer").select("c_custkey", "c_mktsegment")
    return run_to_table(spark, with_lookup(events, customers, "user_id", "c_custkey"), "segments")


STREAM_EVENTS_WITH_SEGMENT_SQL = """
select event_id, user_id, event_type, c_mktsegment from events left join customer on user_id = c_custkey
"""


def stream_running_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Events of each user once the stream has been worked through: its counts of all times at
    which it was not idle for a day."""
    counts = running_counts(_events(spark, data_dir, "user_id", "ts"), "user_id", "ts", "1 day", _delay(spark, data_dir))
    out = run_to_table(spark, counts, "running-counts").groupBy("user_id", "since").agg(F.max("events_so_far").alias("events"))
    return out.groupBy("user_id").agg(F.sum("events").alias("events"))


STREAM_RUNNING_COUNTS_SQL = "select user_id, count(*) as events from events group by user_id"


QUERIES = {
    "stream_hourly_counts": Query(stream_hourly_counts, STREAM_HOURLY_COUNTS_SQL),
    "stream_sliding_counts": Query(stream_sliding_counts, SLIDING_EVENT_COUNTS_SQL),
    "stream_sessions": Query(stream_sessions, SQL_SESSIONS),
    "stream_first_events": Query(stream_first_events, FIRST_EVENTS_SQL),
    "stream_purchases_soon_after_view": Query(stream_purchases_soon_after_view, PURCHASES_SOON_AFTER_VIEW_SQL),
    "stream_events_with_segment": Query(stream_events_with_segment, STREAM_EVENTS_WITH_SEGMENT_SQL),
    "stream_running_counts": Query(stream_running_counts, STREAM_RUNNING_COUNTS_SQL),
}
