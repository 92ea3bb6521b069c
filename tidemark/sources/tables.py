"""Parquet tables, read as batches or as streams."""

from __future__ import annotations

import datetime
import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_dir


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table ``name``: one Parquet file, or a folder of them."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


#: About how many bytes of files a micro-batch takes.
BATCH_BYTES = 1 << 30


def stream(
    spark: SparkSession,
    data_dir: str,
    name: str,
    event_time: str = "ts",
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """The same table as a stream, by files in the order in which they were written.

    A micro-batch takes files of some ``max_bytes`` (``BATCH_BYTES`` if not given), or
    ``max_files`` files if given, so that state is dropped as the stream goes on and does not
    hold the whole table. Rows are late if they lie further behind those of earlier
    micro-batches than the watermark's delay; ``delay_for_all`` is one that leaves none out.

    Watermarks need a ``timestamp``, and the files hold ``timestamp_ntz``, so the event
    time is cast. The bracket makes the path a pattern, which the file source accepts for
    a single file as well as for a folder.
    """
    schema = table(spark, data_dir, name).schema
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes or BATCH_BYTES))
    rows = reader.parquet(f"{data_dir}/{name}[.]parquet")
    if isinstance(schema[event_time].dataType, T.TimestampNTZType):
        rows = rows.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return rows


def survey(
    spark: SparkSession, data_dir: str, name: str, event_time: str = "ts", least: datetime.timedelta = datetime.timedelta(minutes=10)
) -> tuple[str, bool]:
    """A delay for the watermark with which no row of the table is late, however its files are
    ordered and fall into micro-batches; and whether all of them go into one.

    The delay is ``least``, or by how much a file goes back behind one written before it or in the
    same millisecond. Files in the order of time need no more than ``least``. Where each file spans the whole
    period, so does the delay, and state is kept until the end. One row a file is collected;
    the driver lists the files for the stream anyway.
    """
    time = F.unix_micros(F.col(event_time).cast("timestamp"))
    rows = table(spark, data_dir, name).select(
        "_metadata.file_path", F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_size").alias("size"), time.alias("time")
    )
    files = rows.groupBy("file_path", "written", "size").agg(F.min("time").alias("first"), F.max("time").alias("last")).collect()
    back, latest = 0, None
    found = sorted((f["written"], f["first"], f["last"]) for f in files if f["first"] is not None)
    for _, group in itertools.groupby(found, key=lambda f: f[0]):
        together = list(group)
        if len(together) > 1:
            latest = max(f[2] for f in together) if latest is None else max(latest, *(f[2] for f in together))
        for _, first, _ in together:
            latest = first if latest is None else latest
            back = max(back, latest - first)
        latest = max(latest, *(f[2] for f in together))
    # watermarks are in milliseconds
    return f"{max(back // 1000 + 1, least // datetime.timedelta(milliseconds=1))} milliseconds", sum(f["size"] for f in files) <= BATCH_BYTES


def delay_for_all(spark: SparkSession, data_dir: str, name: str, event_time: str = "ts", **how) -> str:
    return survey(spark, data_dir, name, event_time, **how)[0]


#: Later than any event; windows around it never end.
END_OF_TIME = datetime.datetime(2262, 1, 1)


def closable_stream(
    spark: SparkSession, data_dir: str, name: str, columns: list[str], event_time: str = "ts", **how
) -> tuple[DataFrame, Callable[[], None]]:
    """``columns`` of the table as a stream, and a function that closes it.

    Windows and sessions come out once the watermark has passed them, and the last events do
    not move it that far. Closing adds one row far in the future, null but for its time, which
    does. That row's own window stays open, so it is in no result. Rows that come after it are
    late.
    """
    events = stream(spark, data_dir, name, event_time, **how).select(*columns)
    folder = shared_dir(spark, f"{name}-end")
    none = spark.createDataFrame([], events.schema)
    none.write.parquet(f"{folder}/{name}.parquet")
    ends = spark.readStream.schema(events.schema).parquet(f"{folder}/{name}[.]parquet")

    def close() -> None:
        row = tuple(END_OF_TIME if c == event_time else None for c in events.columns)
        spark.createDataFrame([row], events.schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")

    return events.unionByName(ends), close
