"""The values that most rows of a group hold, from mergeable summaries and an exact recount."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grouping import top_per_group
from tidemark.operators.ordered import written

#: Values of one group that a task counts at a time.
COUNTERS = 20_000


class Summary:
    """Counts of the values seen most. Above twice ``most`` values, the count of the one at place
    ``most`` is taken from all, and what is not left with any goes. A count is too low by ``lost`` at most,
    and ``lost`` by no more than the values seen over ``most``."""

    def __init__(self, most: int):
        self.most, self.counts, self.lost = most, Counter(), 0

    def add(self, values: list) -> None:
        self.counts.update(values)
        if len(self.counts) > 2 * self.most:
            least = sorted(self.counts.values(), reverse=True)[self.most]
            self.lost += least
            self.counts = Counter({v: n - least for v, n in self.counts.items() if n > least})


def summaries(df: DataFrame, group: str, values: str, counters: int) -> DataFrame:
    """(group, value, n): each task's counts, and in the rows with a null value by how much they may be too low."""
    kind = pa.schema([("group", pa.string()), ("value", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Summary] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for g, found in zip(part["group"].to_pylist(), part["values"].to_pylist(), strict=True):
                    held.setdefault(g, Summary(counters)).add([v for v in found or [] if v is not None])
        for g, s in held.items():
            items = [*s.counts.items(), (None, s.lost)]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(items), pa.string()), pa.array([v for v, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], schema=kind)

    rows = df.select(F.col(group).cast("string").alias("group"), F.col(values).alias("values"))
    return rows.mapInArrow(run, "group string, value string, n bigint").groupBy("group", "value").agg(F.sum("n").alias("n"))


def most_widespread(df: DataFrame, group: str, values: str, k: int, counters: int = COUNTERS) -> DataFrame:
    """(group, value, rows, place): the ``k`` values that most rows of each group hold, with exact
    counts, ties to the lesser value. ``values`` is an array of different strings in each row.

    Each task keeps a bounded summary for every group, and summaries add up: a value's rows are
    between its summed count and that and the summed ``lost`` of its group. A value can be among
    the first ``k`` only if its upper end reaches the ``k``-th largest count, so those are recounted exactly and
    none is lost. Where ``lost`` itself reaches that count, a value that no summary holds could be as
    frequent, and the summaries are made again with four times the counters.

    Null groups are a group, null values and rows count for nothing. An empty table gives no rows.
    """
    while True:
        found = written(summaries(df, group, values, counters))
        lost = found.where("value is null").select("group", F.col("n").alias("lost"))
        ranked = top_per_group(found.where("value is not null"), ["group"], [F.desc("n")], k)
        bar = ranked.groupBy("group").agg(F.min("n").alias("least"), F.count("*").alias("held"))
        both = lost.alias("l").join(bar.alias("b"), F.expr("l.group <=> b.group"), "left")
        bars = both.select("l.group", "lost", F.when(F.col("held") == k, F.col("least")).otherwise(F.lit(1)).alias("least"))
        if not bars.where(F.col("lost") >= F.col("least")).take(1):
            break
        counters *= 4
    wanted = found.where("value is not null").alias("f").join(bars.alias("b"), F.expr("f.group <=> b.group")).where("n + lost >= least").select("f.group", "value")
    each = df.select(F.col(group).cast("string").alias("group"), F.explode(values).alias("value"))
    exact = each.alias("e").join(wanted.alias("w"), F.expr("e.group <=> w.group and e.value = w.value"), "left_semi").groupBy("group", "value").agg(F.count("*").alias("rows"))
    best = top_per_group(exact, ["group"], [F.desc("rows"), F.asc("value")], k)
    return best.select(F.col("group").alias(group), "value", "rows", F.col("place").cast("bigint").alias("place"))
