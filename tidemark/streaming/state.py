"""Counts kept for each key as a stream goes on, until the key has been idle for a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "_key string, events_so_far bigint, since bigint"
STATE = "events bigint, since bigint, last bigint"


class IdleCounts(StatefulProcessor):
    """One count a key, with a timer in event time for when the key will have been idle for ``idle_us``.
    When it goes off, the key's state goes, or a new one is set if there were events since."""

    def __init__(self, idle_us: int, ttl_ms: int | None):
        self.idle_us, self.ttl_ms = idle_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", STATE, self.ttl_ms)

    def goes_off(self, last: int) -> int:
        return (last + self.idle_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.count.get()
        events, since, last = held or (0, None, None)
        for page in rows:
            events += int(page["n"].sum())
            first, latest = int(page["first_us"].min()), int(page["last_us"].max())
            since = first if since is None else since
            last = latest if last is None else max(last, latest)
        self.count.update((events, since, last))
        if held is None:
            self.handle.registerTimer(self.goes_off(last))
        yield pd.DataFrame({"_key": [key[0]], "events_so_far": [events], "since": [since]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.count.get()
        if held is not None:
            due = self.goes_off(held[2])
            if due > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(due)
            else:
                self.count.clear()
        return iter([])

    def close(self) -> None:
        pass


def running_counts(
    events: DataFrame, key: str, time: str, idle: str = "1 day", delay: str = "10 minutes", ttl_ms: int | None = None
) -> DataFrame:
    """(key, events_so_far, since): the number of events so far of each key in a micro-batch, given
    out once per batch. Once the watermark, ``delay`` behind the latest event, lies ``idle`` or more after a key's last
    event, the key's state goes, and should it come again its count begins anew with another ``since``. So state holds the keys of late and not all there ever were. ``ttl_ms`` also lets
    state go that long after its last change by the clock, for streams whose event time stands
    still. Rows later than the watermark are left out.

    Rows are counted per Arrow batch first, so a busy key sends one row for each of those
    to its state and not one for each event. Keys travel as JSON: pandas would turn whole
    numbers beside a null into floats and merge large ones. A null is a key of its own. Events
    without a time are left out.
    """
    kind = pa.schema([("_key", pa.string()), ("n", pa.int64()), ("first_us", pa.int64()), ("last_us", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by("_key").aggregate([([], "count_all"), ("_us", "min"), ("_us", "max")])
            found = found.select(["_key", "count_all", "_us_min", "_us_max"]).rename_columns(kind.names)
            yield from found.cast(kind).to_batches()

    idle_us = events.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + interval {idle})")).first()[0]
    keyed = events.where(F.col(time).isNotNull()).select(F.to_json(F.struct(F.col(key).alias("k"))).alias("_key"), F.unix_micros(F.col(time).cast("timestamp")).alias("_us"))
    partial = keyed.mapInArrow(count, "_key string, n bigint, first_us bigint, last_us bigint")
    # a row of sums is late only if all of its events are
    partial = partial.withColumn("_last", F.timestamp_micros("last_us")).withWatermark("_last", delay)
    sums = partial.groupBy("_key").transformWithStateInPandas(IdleCounts(idle_us, ttl_ms), OUT, "Append", "EventTime")
    back = F.from_json("_key", T.StructType([T.StructField("k", events.schema[key].dataType)]))["k"]
    return sums.select(back.alias(key), "events_so_far", F.timestamp_micros("since").alias("since"))
