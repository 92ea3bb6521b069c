"""Keys that many members hold, without counting them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held_by_at_least(df: DataFrame, key: str, member: str, n: int) -> DataFrame:
    """(key, first members): keys of ``df`` that at least ``n`` different members hold, with the ``n``
    least members in ``members``. Null keys and members are left out.

    Counting stops at ``n``: map tasks pass on the rows of the ``n`` least members of each key, by a limit on
    their rank, and so does every later step. A key that a third of all rows hold costs ``n``
    members a task, where a distinct count would send all of them. ``n`` is to be small (below Spark's
    threshold for such limits, 1,000); ``df`` is to hold a pair of key and member once, or few times.
    """
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(member))
    rows = df.select(key, member).where(F.col(key).isNotNull() & F.col(member).isNotNull())
    least = rows.withColumn("_rank", rank).where(F.col("_rank") <= n)
    return least.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members")).where(F.size("members") >= n)
