"""Rank measures, from a row's number in its group and the size of the group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntile_of(number: Column, size: Column, n: int) -> Column:
    """Which of ``n`` nearly equal tiles a row is in; the first tiles take the rest."""
    small = F.floor(size / n)
    rest = size % n
    in_large = number <= (small + 1) * rest
    return (
        F.when(in_large, F.floor((number - 1) / (small + 1)))
        .otherwise(rest + F.floor((number - 1 - (small + 1) * rest) / F.greatest(small, F.lit(1))))
        .cast("long")
        + 1
    )


def percent_rank_of(rank: Column, size: Column) -> Column:
    """Rank scaled to 0..1, and 0 for a row alone in its group."""
    return F.when(size > 1, (rank - 1) / (size - 1)).otherwise(F.lit(0.0))
