"""Streams over several files: late rows, repeats, restarts and hot keys."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from oracle import normal, run_sql
from pyspark.sql import functions as F

from tidemark.plans.streams import QUERIES
from tidemark.session import shared_dir
from tidemark.sources import closable_stream, delay_for_all, stream, table, tables
from tidemark.streaming import (
    first_within,
    matched_within,
    run_to_table,
    running_counts,
    session_sums,
    window_sums,
    with_lookup,
)

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"


def counted():
    return {"n": F.count(F.lit(1))}


def at(minutes):
    return START + timedelta(minutes=minutes)


class Feed:
    """A folder that files are added to, one micro-batch each."""

    def __init__(self, spark):
        self.spark, self.dir = spark, shared_dir(spark, "feed")
        self.next_id = 0

    def add(self, *rows):
        data = []
        for minutes, user, kind in rows:
            data.append((self.next_id, at(minutes), user, kind))
            self.next_id += 1
        df = self.spark.createDataFrame(data, SCHEMA).coalesce(1)
        df.write.mode("append").parquet(f"{self.dir}/events.parquet")
        return self

    def stream(self):
        return stream(self.spark, self.dir, "events", max_files=1)


@pytest.fixture
def feed(spark):
    return Feed(spark)


def in_utc(df, *columns):
    return sorted(tuple(r) for r in df.withColumns({c: F.col(c).cast("string") for c in columns}).collect())


def test_late_rows_are_dropped_and_open_windows_held_back(spark, feed):
    feed.add((5, 1, "a"), (50, 1, "a")).add((130, 1, "a")).add((131, 1, "a"))
    feed.add((20, 1, "late")).add((200, 1, "a"))
    out = run_to_table(spark, window_sums(feed.stream(), [], "ts", "1 hour", counted()), "w")
    assert in_utc(out.select("window_start", "n"), "window_start") == [
        ("2024-01-01 00:00:00", 2),
        ("2024-01-01 02:00:00", 2),
    ]


def test_overlapping_windows(spark, feed):
    feed.add((70, 1, "a")).add((600, 1, "a"))
    out = run_to_table(spark, window_sums(feed.stream(), [], "ts", "2 hours", counted(), hop="1 hour"), "w")
    assert in_utc(out.select("window_start", "n"), "window_start") == [
        ("2024-01-01 00:00:00", 1),
        ("2024-01-01 01:00:00", 1),
    ]


def test_sessions_go_on_over_batches(spark, feed):
    feed.add((0, 1, "a"), (20, 1, "a"), (0, 2, "a")).add((50, 1, "a"), (31, 2, "a")).add((500, 3, "a"))
    out = run_to_table(spark, session_sums(feed.stream(), "user_id", "ts", "30 minutes", counted()), "s")
    assert in_utc(out.select("user_id", "session_start", "session_end", "n"), "session_start", "session_end") == [
        (1, "2024-01-01 00:00:00", "2024-01-01 01:20:00", 3),
        (2, "2024-01-01 00:00:00", "2024-01-01 00:30:00", 1),
        (2, "2024-01-01 00:31:00", "2024-01-01 01:01:00", 1),
    ]


def test_restart_repeats_nothing(spark, feed):
    path, checkpoint = shared_dir(spark, "out"), shared_dir(spark, "checkpoint")

    def run():
        return run_to_table(spark, running_counts(feed.stream(), "user_id", "ts"), "c", path, checkpoint).drop("since")

    feed.add((0, 1, "a"), (1, 1, "a"), (2, 2, "a"))
    assert sorted(map(tuple, run().collect())) == [(1, 2), (2, 1)]
    feed.add((3, 1, "a")).add((4, 2, "a"), (5, 3, "a"))
    assert sorted(map(tuple, run().collect())) == [(1, 2), (1, 3), (2, 1), (2, 2), (3, 1)]
    assert run().count() == 5


def test_idle_keys_leave_and_begin_anew(spark, feed):
    """After a restart too; the number of keys in state is what the query reports."""
    path, checkpoint = shared_dir(spark, "out"), shared_dir(spark, "checkpoint")

    def run():
        counts = running_counts(feed.stream(), "user_id", "ts", idle="1 hour", delay="1 minute")
        query = counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        query.awaitTermination()
        rows = {}
        for r in spark.read.schema(counts.schema).parquet(path).collect():
            rows[r.user_id, r.since] = max(rows.get((r.user_id, r.since), 0), r.events_so_far)
        return rows, query.lastProgress["stateOperators"][0]["customMetrics"]

    feed.add((0, 1, "a"), (30, 1, "a"), (20, 2, "a"))
    run()
    feed.add((80, 1, "a"), (90, 3, "a"))  # 80 is 50 after 30; 2 is idle for an hour at 80
    feed.add((95, 3, "a"))
    run()
    feed.add((150, 2, "a"), (151, 1, "a"), (151, 2, "a")).add((400, 9, "a"))
    rows, _ = run()
    # the watermark had passed 2's hour, not yet 1's
    assert rows == {(1, at(0)): 4, (2, at(20)): 1, (3, at(90)): 2, (2, at(150)): 2, (9, at(400)): 1}
    # at 400 all but one key have been idle
    values = spark.read.format("statestore").option("stateVarName", "count").load(checkpoint)
    assert values.count() == 1


def firsts(spark, feed, closed=True):
    events, close = closable_stream(spark, feed.dir, "events", ["event_id", "ts", "user_id", "event_type"], max_files=1)
    out = first_within(events, ["user_id", "event_type"], "ts", "event_id", "10 minutes")
    got = run_to_table(spark, out, "d", close=close if closed else None)
    return sorted((r.user_id, r.event_type, r.event_id) for r in got.collect())


def test_firsts_of_runs(spark, feed):
    feed.add(*[(i, 1, "a") for i in range(0, 40, 5)], (1, 1, "b"), (2, 2, "a"))
    feed.add((50, 1, "a"), (45, 2, "a"), (45, 2, "a")).add((60, 1, "a"), (71, 1, "a"))
    # 50 is 15 after 35; 60 is 10 after 50 and so goes with it; 71 is 11 after 60
    assert firsts(spark, feed) == [(1, "a", 0), (1, "a", 10), (1, "a", 14), (1, "b", 8), (2, "a", 9), (2, "a", 11)]


def test_an_on_time_row_survives_a_late_one_of_its_key(spark, feed):
    feed.add((0, 1, "a"), (200, 9, "x")).add((201, 9, "x")).add((5, 2, "a"), (201, 2, "a"), (202, 9, "x")).add((203, 9, "x"))
    assert (2, "a", 4) in firsts(spark, feed)


@pytest.mark.parametrize("files", [1, 3, 10])
def test_firsts_do_not_depend_on_batches(spark, feed, files):
    rows = [(m, m % 3, "a") for m in range(0, 120, 4)]
    for k in range(files):
        feed.add(*rows[k * 30 // files : (k + 1) * 30 // files])
    # a user's events are twelve minutes apart, so each is a first
    assert firsts(spark, feed) == sorted((user, "a", i) for i, (_, user, _) in enumerate(rows))


def test_closing_brings_out_what_is_open(spark, feed):
    feed.add((5, 1, "a"), (50, 1, "a")).add((130, 1, "a"))
    events, close = closable_stream(spark, feed.dir, "events", ["ts", "user_id"], max_files=1)
    out = run_to_table(spark, window_sums(events, [], "ts", "1 hour", counted()), "w", close=close)
    assert in_utc(out.select("window_start", "n"), "window_start") == [("2024-01-01 00:00:00", 2), ("2024-01-01 02:00:00", 1)]


def test_large_keys_beside_a_null_stay_apart(spark, feed):
    feed.add((0, 2**53, "a"), (0, 2**53 + 1, "a"), (0, None, "a"), (1, 2**53 + 1, "a"))
    out = run_to_table(spark, running_counts(feed.stream(), "user_id", "ts"), "c").drop("since")
    assert {tuple(r) for r in out.collect()} == {(2**53, 1), (2**53 + 1, 2), (None, 1)}


def matches(feed, **how):
    events = feed.stream().select("event_id", "ts", "user_id", "event_type")
    again = feed.stream().select("event_id", "ts", "user_id", "event_type")
    return matched_within(
        events.where("event_type = 'buy'"), again.where("event_type = 'view'"), "user_id", "ts", "event_id", "2 hours", **how
    )


def test_matched_within(spark, feed):
    feed.add((0, 1, "view"), (10, 1, "buy"), (10, 2, "buy"), (11, 2, "view"))
    feed.add((121, 1, "buy"), (120, 1, "buy"), (30, 3, "view"), (30, 3, "buy"))
    got = run_to_table(spark, matches(feed, delay="1 day"), "m")
    assert sorted(r.event_id for r in got.collect()) == [1, 5, 7]


def test_matches_after_a_restart_with_a_busier_user(spark, feed):
    path, checkpoint = shared_dir(spark, "out"), shared_dir(spark, "checkpoint")
    feed.add((0, 1, "view"), *[(1, 9, "x") for _ in range(20)])
    assert run_to_table(spark, matches(feed, delay="1 day"), "m", path, checkpoint).count() == 0
    feed.add(*[(10 + i, 1, "buy") for i in range(8)])
    assert run_to_table(spark, matches(feed, delay="1 day"), "m", path, checkpoint).count() == 8


def test_with_lookup(spark, feed):
    feed.add(*[(i, 1, "a") for i in range(30)], (0, 2, "a"), (0, 7, "a"), (0, 9, "a"))
    names = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k bigint, name string")
    out = run_to_table(spark, with_lookup(feed.stream(), names, "user_id", "k"), "l")
    assert Counter((r.user_id, r["name"]) for r in out.collect()) == {
        (1, "one"): 30, (2, "two"): 1, (7, None): 1, (9, None): 1,
    }
    assert out.columns == ["event_id", "ts", "user_id", "event_type", "name"]


def test_delay_by_how_far_files_go_back(spark, feed):
    assert delay_for_all(spark, feed.add((0, None, "a"), (90, 1, "a")).dir, "events") == "600000 milliseconds"
    assert delay_for_all(spark, feed.add((85, 1, "a"), (300, 1, "a")).dir, "events") == "600000 milliseconds"
    assert delay_for_all(spark, feed.add((400, 1, "a")).add((270, 1, "a")).dir, "events") == f"{130 * 60_000 + 1} milliseconds"


@pytest.fixture(scope="module")
def unordered(spark, data_dir):
    """The events in files of which each spans the whole period."""
    folder = shared_dir(spark, "unordered")
    for k in range(4):
        part = table(spark, data_dir, "events").where(F.pmod(F.hash("event_id"), F.lit(4)) == k)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_events_with_segment", "stream_running_counts"}))
def test_queries_lose_no_row_of_unordered_files(spark, data_dir, unordered, monkeypatch, name):
    monkeypatch.setattr(tables, "BATCH_BYTES", 1)  # a micro-batch for each file
    got = QUERIES[name](spark, unordered)
    names, _, expected = run_sql(QUERIES[name].sql, data_dir)
    assert normal(got.columns, [tuple(r) for r in got.collect()]) == normal(names, expected)
