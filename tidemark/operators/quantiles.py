"""Exact quantiles of groups too large for one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import OrderedGroups

ACCURACY = 100_000
MARGIN = 0.001
SMALL_GROUP = 10_000


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    longest_group: int | None = None,
    **limits,
) -> DataFrame:
    """One row per group and a column per probability, interpolated between two values.

    ``percentile`` keeps a map of all values of a group in one task. Here a sketch first
    gives a narrow slice of values around each quantile, ``MARGIN`` of the rows to either
    side, a hundred times the sketch's own error. Values below a slice are only counted. Those
    inside are brought down to a count per value and put in order, which finds the ranks.
    A group of under ``SMALL_GROUP`` rows is its own slice.

    ``longest_group`` and ``limits`` are as in ``OrderedGroups``, which puts the slices in
    order, for slices that are long themselves.
    """
    names = list(probabilities)
    rows = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    around = [max(0.0, probabilities[n] - MARGIN) for n in names]
    around += [min(1.0, probabilities[n] + MARGIN) for n in names]
    bounds = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(p) for p in around]), F.lit(ACCURACY)).alias("_b"),
    )
    small = F.col("_n") < SMALL_GROUP
    slices = bounds.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("_name"),
                        ((F.col("_n") - 1) * F.lit(probabilities[n])).alias("_at"),
                        F.when(small, F.col("_min")).otherwise(F.col("_b")[i]).alias("_low"),
                        F.when(small, F.col("_max")).otherwise(F.col("_b")[i + len(names)]).alias("_high"),
                    )
                    for i, n in enumerate(names)
                ]
            )
        ).alias("_s"),
    ).select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_s.*")

    # a count per value, then one more for all values below a slice, which sorts first
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    slice_keys = [*keys, "_name"]
    same = reduce(lambda a, b: a & b, [counts[k].eqNullSafe(slices[f"_of_{k}"]) for k in keys])
    in_or_below = counts.join(slices, same).where(F.col("_v") <= F.col("_high"))
    folded = in_or_below.groupBy(*slice_keys, "_at", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(
        F.sum("_c").alias("_c")
    )
    if longest_group is not None:
        # a slice has at most its margins, the sketch's error and a small group's rows
        longest_group = SMALL_GROUP + math.ceil(longest_group * (2 * MARGIN + 4 / ACCURACY))
    ordered = OrderedGroups(folded, slice_keys, ["_v"], longest_group=longest_group, **limits)
    ranked = ordered.running(_upto=("sum", F.col("_c"))).df()

    def value_at(position):
        here = position.between(F.col("_upto") - F.col("_c"), F.col("_upto") - 1)
        return F.max(F.when(here, F.col("_v")))

    floor, ceil = F.floor("_at"), F.ceil("_at")
    found = ranked.groupBy(*slice_keys).agg(
        value_at(floor).alias("_lo"),
        value_at(ceil).alias("_hi"),
        F.max(F.col("_at") - floor).alias("_part"),
    )
    # the sketch's error bound puts both ranks inside the slice; stop if it ever did not
    exact = F.when(
        F.col("_lo").isNull() | F.col("_hi").isNull(), F.raise_error(F.lit("quantile outside its slice"))
    ).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    wide = found.withColumn("_q", exact).groupBy(*keys)
    return wide.agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in names])
