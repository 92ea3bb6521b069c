"""What the operators of this subpackage share: words, tables, and rows kept in the shared folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: A word is a run of anything but the six ASCII white-space characters.
WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark: SparkSession, data_dir: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/documents.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``; a null text becomes an empty one.

    Whatever else ``df`` holds, under whatever name, goes no further, so it cannot clash; the
    columns named in ``carry`` come along in a struct ``carried``.
    """
    return df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written under the folder that all executors share, and read from there.

    It is worked out once however often it is used, and a lost executor costs nothing.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(spark: SparkSession, value: object) -> Broadcast:
    """``value`` for executors, packed with what is needed to unpack it there: ``pickle.loads``.
    Only for things whose size a vocabulary or another parameter bounds."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def per_batch(
    make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: pa.Schema, rows: int = 512
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow``: ``make`` is called once in each task, what it returns
    once for every ``rows`` rows, so that little is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(work(batch.slice(at, rows)), schema=schema)

    return run
