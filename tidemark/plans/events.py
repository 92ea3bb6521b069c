"""Queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import as_double, named, part_sums, sum_of, units
from tidemark.operators import OrderedGroups, consecutive_days, hop_windows, last_before, sessions
from tidemark.plans.registry import Query
from tidemark.sources import table
from tidemark.streaming.dedup import first_within

SQL_VALUE = "cast(round(sum(cast(value as decimal(12,2))), 2) as double)"


def _sums() -> dict:
    return {"events": F.count(F.lit(1)), **part_sums("total", units("value"))}


def _with_total(df: DataFrame) -> DataFrame:
    return df.withColumn("total", as_double(sum_of("total"))).drop("total_high", "total_low")


def _events(spark: SparkSession, data_dir: str, *columns: str) -> DataFrame:
    return table(spark, data_dir, "events").select(*columns)


def _row_bound(spark: SparkSession, data_dir: str, limits: dict) -> dict:
    """The size of the whole table, from its footers, bounds any part of it."""
    if "longest_group" not in limits:
        limits["longest_group"] = table(spark, data_dir, "events").count()
    return limits


def view_before_purchase(spark: SparkSession, data_dir: str, **limits) -> DataFrame:
    """Each purchase with the user's last view before it, if any."""
    events = _events(spark, data_dir, "event_id", "ts", "user_id", "event_type")
    found = last_before(
        events,
        ["user_id"],
        ["ts", "event_id"],
        left=F.col("event_type") == "purchase",
        right=F.col("event_type") == "view",
        prefix="view_",
        **_row_bound(spark, data_dir, limits),
    )
    return found.select("event_id", "user_id", "ts", "view_event_id", "view_ts")


VIEW_BEFORE_PURCHASE_SQL = """
select event_id, user_id, ts, view_event_id, view_ts
from (select event_id, user_id, ts, event_type,
             last_value(case when event_type = 'view' then event_id end ignore nulls) over earlier as view_event_id,
             last_value(case when event_type = 'view' then ts end ignore nulls) over earlier as view_ts
      from events
      window earlier as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
where event_type = 'purchase'
"""


def purchases_soon_after_view(spark: SparkSession, data_dir: str, **limits) -> DataFrame:
    """Purchases with a view by the same user in the two hours before.

    Whether one exists is a question about the last view only, so no pairs are made.
    """
    found = view_before_purchase(spark, data_dir, **limits)
    return found.where(F.col("ts") <= F.col("view_ts") + F.expr("interval 2 hours")).select("event_id", "user_id", "ts")


PURCHASES_SOON_AFTER_VIEW_SQL = """
select event_id, user_id, ts from events p
where event_type = 'purchase' and exists (
  select 1 from events v where v.user_id = p.user_id and v.event_type = 'view'
  and (v.ts, v.event_id) < (p.ts, p.event_id) and v.ts >= p.ts - interval 2 hours)
"""


def hourly_event_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    events = _events(spark, data_dir, "ts", "event_type", "value")
    hours = events.groupBy(F.window("ts", "1 hour").alias("hour"), "event_type").agg(*named(_sums()))
    return _with_total(hours).select(F.col("hour.start").alias("window_start"), "event_type", "events", "total")


HOURLY_EVENT_COUNTS_SQL = f"""
select date_trunc('hour', ts) as window_start, event_type, count(*) as events, {SQL_VALUE} as total
from events group by 1, 2
"""


def sliding_event_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Two-hour windows, one starting each hour."""
    events = _events(spark, data_dir, "ts", "value")
    return _with_total(hop_windows(events, [], "ts", 2, 1, _sums()))


SLIDING_EVENT_COUNTS_SQL = f"""
select window_start, window_start + interval 2 hours as window_end, count(*) as events, {SQL_VALUE} as total
from (select value, unnest([date_trunc('hour', ts) - interval 1 hour, date_trunc('hour', ts)]) as window_start
      from events)
group by 1, 2
"""


def user_sessions(spark: SparkSession, data_dir: str) -> DataFrame:
    """Sessions per user that end 30 minutes after their last event."""
    events = _events(spark, data_dir, "user_id", "ts", "value")
    return _with_total(sessions(events, "user_id", "ts", 30, _sums()))


SQL_SESSIONS = f"""
select user_id, min(ts) as session_start, max(ts) + interval 30 minutes as session_end,
       count(*) as events, {SQL_VALUE} as total
from (select *, sum(starts) over (partition by user_id order by ts rows unbounded preceding) as session
      from (select *, case when ts > lag(ts) over (partition by user_id order by ts) + interval 30 minutes
                           then 1 else 0 end as starts
            from events))
group by user_id, session
"""


def funnel(spark: SparkSession, data_dir: str, **limits) -> DataFrame:
    """Users with a view, with a click after their first view, and with a purchase after
    that click and within a day of the view.

    The first view and the first click so far are carried along each user's events, so
    the steps need one shuffle and no joins of events with events.
    """
    events = _events(spark, data_dir, "user_id", "ts", "event_id", "event_type").where(
        F.col("event_type").isin("view", "click", "purchase")
    )
    ts, kind = F.col("ts"), F.col("event_type")
    steps = (
        OrderedGroups(events, ["user_id"], ["ts", "event_id"], **_row_bound(spark, data_dir, limits))
        .running(viewed=("min", F.when(kind == "view", ts)))
        .running(clicked=("min", F.when((kind == "click") & (ts > F.col("viewed")), ts)))
        .df()
    )
    in_time = (ts > F.col("clicked")) & (ts <= F.col("viewed") + F.expr("interval 1 day"))
    per_user = steps.groupBy("user_id").agg(
        F.count("viewed").cast("boolean").alias("viewed"),
        F.count("clicked").cast("boolean").alias("clicked"),
        F.count(F.when((kind == "purchase") & in_time, 1)).cast("boolean").alias("bought"),
    )
    return per_user.agg(*[F.count_if(n).alias(n) for n in ("viewed", "clicked", "bought")])


FUNNEL_SQL = """
with v as (select user_id, min(ts) as viewed from events where event_type = 'view' group by 1),
c as (select e.user_id, viewed, min(ts) as clicked from events e join v on e.user_id = v.user_id
      where event_type = 'click' and ts > viewed group by 1, 2),
p as (select distinct e.user_id from events e join c on e.user_id = c.user_id
      where event_type = 'purchase' and ts > clicked and ts <= viewed + interval 1 day)
select (select count(*) from v) as viewed, (select count(*) from c) as clicked, (select count(*) from p) as bought
"""


def first_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """Events that follow no other of the same user and type within ten minutes."""
    events = _events(spark, data_dir, "event_id", "ts", "user_id", "event_type")
    return first_within(events, ["user_id", "event_type"], "ts", "event_id", "10 minutes")


FIRST_EVENTS_SQL = """
select event_id, ts, user_id, event_type
from (select *, lag(ts) over (partition by user_id, event_type order by ts, event_id) as before from events)
where before is null or ts > before + interval 10 minutes
"""


def active_day_runs(spark: SparkSession, data_dir: str) -> DataFrame:
    """Runs of consecutive days on which a user has events."""
    return consecutive_days(_events(spark, data_dir, "user_id", "ts"), "user_id", "ts")


ACTIVE_DAY_RUNS_SQL = """
select user_id, min(d) as first_day, max(d) as last_day, count(*) as days
from (select *, d - cast(row_number() over (partition by user_id order by d) as integer) as run
      from (select distinct user_id, cast(ts as date) as d from events))
group by user_id, run
"""


def props_key_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Events counted by a number inside a JSON column; text that is no number gives null."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return _events(spark, data_dir, "props").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("events"))


PROPS_KEY_COUNTS_SQL = """
select try_cast(props::json->>'$.k' as bigint) as k, count(*) as events from events group by 1
"""


QUERIES = {
    "view_before_purchase": Query(view_before_purchase, VIEW_BEFORE_PURCHASE_SQL),
    "purchases_soon_after_view": Query(purchases_soon_after_view, PURCHASES_SOON_AFTER_VIEW_SQL),
    "hourly_event_counts": Query(hourly_event_counts, HOURLY_EVENT_COUNTS_SQL),
    "sliding_event_counts": Query(sliding_event_counts, SLIDING_EVENT_COUNTS_SQL),
    "user_sessions": Query(user_sessions, SQL_SESSIONS),
    "first_events": Query(first_events, FIRST_EVENTS_SQL),
    "funnel": Query(funnel, FUNNEL_SQL),
    "active_day_runs": Query(active_day_runs, ACTIVE_DAY_RUNS_SQL),
    "props_key_counts": Query(props_key_counts, PROPS_KEY_COUNTS_SQL),
}
