"""Streams written to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_dir


def run_to_table(
    spark: SparkSession,
    rows: DataFrame,
    name: str,
    path: str | None = None,
    checkpoint: str | None = None,
    close: Callable[[], None] | None = None,
    one_batch: bool = False,
) -> DataFrame:
    """Work through all input there is, append the results to a Parquet table and read it.

    The file sink commits each micro-batch once, so a stream that is started again with the
    same ``path`` and ``checkpoint`` goes on where it stopped and repeats nothing. ``close``,
    from ``sources.closable_stream``, says that no more input will come: what is still open
    then comes out as well. It is said after all input has been worked through, as rows after it are late;
    or from the start, if all input is known to be ``one_batch``, which saves starting the stream again.
    Without a ``path`` a new one is taken; its owner removes it.
    """
    path = path or shared_dir(spark, f"{name}-table")
    checkpoint = checkpoint or shared_dir(spark, f"{name}-checkpoint")

    def go_on() -> None:
        (
            rows.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(path)
            .awaitTermination()
        )

    if close is not None and one_batch:
        close()
    go_on()
    if close is not None and not one_batch:
        close()
        go_on()
    return spark.read.schema(rows.schema).parquet(path)
