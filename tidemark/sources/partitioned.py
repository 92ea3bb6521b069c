"""Tables written in folders by value, and read back with the other folders skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Write ``df`` in one folder per value of ``by``.

    ``rebalance`` gathers each value's rows, so that a folder gets few files, and lets
    adaptive execution split a value that holds far more rows than the others over
    several tasks. A plain ``repartition`` by value would give such a value to one task.
    """
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def read_partitions(spark: SparkSession, path: str, condition: Column) -> DataFrame:
    """Rows of a written table where ``condition``, on its folder columns, holds."""
    return spark.read.parquet(path).where(condition)
