"""Grouping over several column subsets at once, and the first rows of each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_subsets(
    df: DataFrame,
    columns: list[str],
    partial: dict[str, Column],
    group: Callable[[DataFrame], object],
) -> DataFrame:
    """``rollup``, ``cube`` or ``groupingSets`` over sums, on rows already summed up.

    Spark copies each row once per subset before it aggregates. Sums can be taken in two
    steps, so the rows are first brought down to one per combination of ``columns`` and
    only those are copied. ``group`` makes the subsets, as in ``lambda d: d.cube("a", "b")``;
    ``partial`` names sums and counts.
    """
    once = df.groupBy(*columns).agg(*[c.alias(n) for n, c in partial.items()])
    return group(once).agg(
        *[F.sum(n).alias(n) for n in partial],
        F.grouping_id().cast("long").alias("grouping_id"),
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered in ``place``.

    A filter on ``row_number`` makes Spark keep the first ``n`` of each group in every map
    task, before the shuffle, so a long group sends ``n`` rows per task and no more.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)
