"""Joins that stay even when one key holds much of the table.

Sizes of join sides are left to Spark: it broadcasts a side whose known or measured size is
under ``spark.sql.autoBroadcastJoinThreshold``, shuffles both otherwise, and splits skewed
partitions of inner and left joins at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _distinct_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name)).distinct()


def with_match(df: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``others``.

    The keys are made distinct first, in the map tasks and again after the shuffle, since
    Spark cannot split the right side of a semi join.
    """
    return df.join(_distinct_keys(others, other_key, key), key, "left_semi")


def without_match(df: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``others``."""
    return df.join(_distinct_keys(others, other_key, key), key, "left_anti")


def band_join(df: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float, most_bins: int = 10_000) -> DataFrame:
    """Rows joined to every band with ``low <= value < high``; a null bound is open.

    Bands are laid over bins ``width`` wide, and rows meet them by bin number, so Spark
    plans an equi-join and can hash, broadcast or split it. A bare range condition would
    compare each row with each band. Choose ``width`` near the usual band. Bins are counted
    from the lowest to the highest bound there is, with one more on either side for all that
    lies beyond, where open bands end. A band of over ``most_bins`` bins is an error.
    """
    ends = bands.select(F.explode(F.array(low, high)).alias("end")).agg(F.min("end"), F.max("end")).first()
    least, most = (0.0 if e is None else float(e) for e in ends)

    def bin_of(c: Column) -> Column:
        within = F.floor((F.least(F.greatest(c, F.lit(least)), F.lit(most)) - F.lit(least)) / F.lit(float(width)))
        return F.when(c < F.lit(least), F.lit(-1)).when(c.isNotNull(), within).cast("bigint")

    first = F.coalesce(bin_of(F.col(low)), F.lit(-1).cast("bigint"))
    last = F.coalesce(bin_of(F.col(high)), bin_of(F.lit(most)))
    few = F.when(last - first > most_bins, F.raise_error(F.lit("a band covers too many bins: choose a larger width"))).otherwise(F.lit(True))
    laid = bands.where(F.coalesce(F.col(low) < F.col(high), F.lit(True))).where(few).withColumn("_bin", F.explode(F.sequence(first, last)))
    inside = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) < F.col(high)))
    return df.withColumn("_bin", bin_of(F.col(value))).join(laid, "_bin").where(inside).drop("_bin")
