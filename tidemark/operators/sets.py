"""Set operations, with repeats counted before anything is shuffled or copied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows found in both.

    Both sides go through one grouping, which notes where each row was seen. It is combined
    in the map tasks, whereas the join that ``intersect`` plans gets every repeat.
    """
    columns = left.columns
    seen = (
        left.withColumn("_left", F.lit(True))
        .unionByName(right.withColumn("_left", F.lit(False)))
        .groupBy(*columns)
        .agg(F.bool_or("_left").alias("_in_left"), F.bool_and("_left").alias("_in_left_only"))
    )
    return seen.where(F.col("_in_left") & ~F.col("_in_left_only")).select(*columns)


def bag_difference(left: DataFrame, right: DataFrame, block: int = 100_000) -> DataFrame:
    """``left`` less ``right`` with repeats kept: ``m`` copies less ``n`` leave ``m - n``.

    The copies are counted, and the counts subtracted. The copies that are left are written
    out again in blocks of at most ``block``, spread over the tasks, so that a row with very
    many copies is not written out by one task.
    """
    columns = left.columns
    counted = (
        left.withColumn("_n", F.lit(1))
        .unionByName(right.withColumn("_n", F.lit(-1)))
        .groupBy(*columns)
        .agg(F.sum("_n").alias("_left"))
        .where(F.col("_left") > 0)
    )
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_left") - 1) / block))))
    in_block = F.least(F.lit(block), F.col("_left") - F.col("_block") * block)
    return (
        blocks.repartition(*columns, "_block")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), in_block.cast("int"))))
        .select(*columns)
    )
