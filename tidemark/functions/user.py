"""Python functions inside Spark jobs. They get Arrow batches; no group needs to fit in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def aggregate_in_batches(
    df: DataFrame,
    keys: list[str],
    partial: Callable[[pd.DataFrame], dict[str, float]],
    merge: dict[str, str],
) -> DataFrame:
    """An aggregate written in pandas, for groups of any size.

    ``partial`` turns some rows of one group into numbers, and ``merge`` says how the
    numbers of two parts of a group combine: ``"sum"``, ``"min"`` or ``"max"``. Python sees
    one Arrow batch at a time (for ``partial``, as pandas), and Spark merges what comes out, before the shuffle and
    after it. A grouped ``pandas_udf`` would be given each whole group at once.
    """
    schema = T.StructType(
        [df.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in merge]
    )

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # keys stay in Arrow: pandas would turn whole numbers beside a null into floats
            rows = pa.table({**{k: batch[k] for k in keys}, "_row": pa.array(range(batch.num_rows))})
            groups = rows.group_by(keys).aggregate([("_row", "list")])
            found = [partial(batch.take(at.values).to_pandas()) for at in groups["_row_list"].combine_chunks()]
            sums = {n: pa.array([float(f[n]) for f in found], pa.float64()) for n in merge}
            yield from pa.table({**{k: groups[k] for k in keys}, **sums}).to_batches()

    parts = df.mapInArrow(per_batch, schema)
    return parts.groupBy(*keys).agg(*[MERGE[how](n).alias(n) for n, how in merge.items()])


@F.udtf(returnType="batch int, rows bigint, total bigint, first string, last string")
class GreedyBatches:
    """A table function on a table with columns ``name`` and ``amount``, partitioned and ordered: each
    partition's rows, in order, in batches that are closed where the next row would bring the
    sum of amounts over ``most``. One row a batch, with the names of its first and last row.

    A batch begins where the one before it ends, so where it begins depends on all rows before; no window
    or aggregate says that. Rows pass one by one and only a sum is held, in whatever number they
    come; but a partition is one task's work from end to end, so partitions should be short.
    """

    def __init__(self) -> None:
        self.batch = self.rows = self.total = 0
        self.first = self.last = None

    def done(self):
        return self.batch, self.rows, self.total, self.first, self.last

    def eval(self, row, most: int):
        amount = row["amount"] or 0
        if self.rows and self.total + amount > most:
            yield self.done()
            self.batch, self.rows, self.total = self.batch + 1, 0, 0
        if not self.rows:
            self.first = row["name"]
        self.rows, self.total, self.last = self.rows + 1, self.total + amount, row["name"]

    def terminate(self):
        if self.rows:
            yield self.done()
