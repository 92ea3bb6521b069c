"""Running values, lags and ranks over ordered groups of any size.

A plain window gives each group to one task, so a group with a third of all rows makes one
task sort a third of the table. Here a long group is cut into runs of about equal length.
Windows work inside each run, and what the earlier runs pass on to a later one (a total, a
last row, a count) comes from a table with one row per run.

The cuts come from a sample, which is read once, and are then fixed values in the plan: a
row's run depends on nothing but the row, so a task that is run again after losing its
executor gives the same answer. The sample decides where to cut and never which rows are
kept: any cuts give the same results.

Rows that may need cuts are first written to the shared folder. Counting, sampling and all
steps read them from there, so what gives the rows is worked out once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_dir

FOLD = {"sum": F.sum, "min": F.min, "max": F.max}
RUN_ROWS = 2_000_000


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, where it stays until the folder's owner removes it."""
    path = shared_dir(df.sparkSession, "ordered-rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def all_short(longest_group: int | None, run_rows: int = RUN_ROWS, **_) -> bool:
    """Whether a bound on the longest group shows that none needs a cut."""
    return longest_group is not None and longest_group < 2 * run_rows


def find_cuts(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    longest_group: int | None = None,
    run_rows: int = RUN_ROWS,
    max_runs: int = 65_536,
    sampled_per_run: int = 64,
) -> list[Row]:
    """The (keys, order) rows at which long groups are cut; empty when no group is long.

    A run is to have ``run_rows`` rows, or more if the table would then need over
    ``max_runs`` runs. About ``sampled_per_run`` rows are sampled from each, so the sample
    has some ``max_runs * sampled_per_run`` rows and the cuts number about ``max_runs``,
    whatever the size of the table. Groups shorter than a run get no cut.

    ``longest_group`` is an upper bound on the rows of a group that is cheap to have, such
    as the count of the whole table, which Parquet footers hold. When it shows that no
    group is long, nothing is counted or sampled.
    """
    if all_short(longest_group, run_rows):
        return []
    total = df.count()
    if total < 2 * run_rows:
        return []
    per_run = max(run_rows, math.ceil(total / max_runs))
    fraction = min(1.0, sampled_per_run / per_run)
    step = max(1, round(per_run * fraction))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.select(*keys, *order)
        .sample(fraction, seed=17)
        .withColumn("_nth", nth)
        .where(F.col("_nth") % step == 0)
        .drop("_nth")
        .collect()
    )


class OrderedGroups:
    """The rows of ``df``, grouped by ``keys`` and put in ``order`` in each group.

    ``order`` names columns, sorted upwards, that tell any two rows of a group apart. Each
    method adds columns and returns a new object; ``df()`` gives the rows.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], **limits) -> None:
        self.keys, self.order = list(keys), list(order)
        if not all_short(**{"longest_group": None, **limits}):
            df = written(df)
        cuts = find_cuts(df, self.keys, self.order, **limits)
        self.cut = bool(cuts)
        self._rows = self._assign_runs(df, cuts) if cuts else df
        # written rows, before the steps since: what runs pass on is taken from them
        self._base = self._rows

    def df(self) -> DataFrame:
        return self._rows.drop("_cut", "_run") if self.cut else self._rows

    def _with(self, rows: DataFrame, added: list[str]) -> OrderedGroups:
        """After a step. A column that the step put in place of another is no longer in the base."""
        new = object.__new__(OrderedGroups)
        new.keys, new.order, new.cut = self.keys, self.order, self.cut
        new._rows, new._base = rows, self._base.drop(*added)
        return new

    def _ready(self, *names: str) -> OrderedGroups:
        """These rows, with a base that has the columns ``names``.

        Where an earlier step gave one of them, the rows so far are written, so each step is
        worked out once however many follow.
        """
        if not self.cut or {*names} <= {*self._base.columns}:
            return self
        new = self._with(written(self._rows), [])
        new._base = new._rows
        return new

    def _assign_runs(self, df: DataFrame, cuts: list[Row]) -> DataFrame:
        """Add ``_run``, the number of cuts at or before a row, and ``_cut``, whether any exist.

        The number is found by halving: each step adds a power of two if the cut that far
        on is still at or before the row. The steps are plain columns, in generated code.
        """
        by_group = defaultdict(list)
        for cut in cuts:
            by_group[tuple(cut[k] for k in self.keys)].append(tuple(cut[o] for o in self.order))
        position = T.StructType([T.StructField(o, df.schema[o].dataType) for o in self.order])
        schema = T.StructType(
            [T.StructField(f"_cut_{k}", df.schema[k].dataType) for k in self.keys]
            + [T.StructField("_cuts", T.ArrayType(position))]
        )

        def nulls_first(position: tuple) -> list:
            return [(value is not None, value) for value in position]

        held = [(*group, sorted(positions, key=nulls_first)) for group, positions in by_group.items()]
        # about max_runs positions in all, whatever the size of the table
        lookup = F.broadcast(df.sparkSession.createDataFrame(held, schema))
        rows = (
            df.join(lookup, self._same_keys(df, lookup, "_cut_"), "left")
            .withColumn("_cut", F.col("_cuts").isNotNull())
            .withColumn("_run", F.lit(0))
        )
        here = F.struct(*[F.col(o) for o in self.order])
        longest = max(len(positions) for positions in by_group.values())
        for power in reversed(range(longest.bit_length())):
            on = F.col("_run") + F.lit(1 << power)
            rows = rows.withColumn("_run", F.when(F.get("_cuts", on - 1) <= here, on).otherwise(F.col("_run")))
        return rows.drop("_cuts", *[f"_cut_{k}" for k in self.keys])

    def _same_keys(self, left: DataFrame, right: DataFrame, prefix: str) -> Column:
        return reduce(
            lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in self.keys]
        )

    def _group(self) -> list[str]:
        return [*self.keys, "_cut", "_run"] if self.cut else self.keys

    def _in_run(self):
        return Window.partitionBy(*self._group()).orderBy(*self.order)

    def _across_runs(self):
        return Window.partitionBy(*self.keys).orderBy("_run")

    def _long(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("_cut"))

    def _join_per_run(self, rows: DataFrame, extra: DataFrame, on: tuple[str, ...]) -> DataFrame:
        """Left join a table with at most a few rows per run of a cut group.

        Its size is bounded by the number of cuts (see ``find_cuts``), not by the data.
        """
        names = [*self.keys, *on]
        extra = extra.withColumnsRenamed({n: f"_of_{n}" for n in names})
        same = self._same_keys(rows, extra, "_of_")
        for n in on:
            same = same & (rows[n] == extra[f"_of_{n}"])
        return rows.join(F.broadcast(extra), same, "left").drop(*[f"_of_{n}" for n in names])

    def running(self, **columns: tuple[str, Column]) -> OrderedGroups:
        """Fold values from the start of the group to the row itself.

        Each column is a pair of ``"sum"``, ``"min"`` or ``"max"`` and the value to fold.
        Nulls are passed over. Long groups are read once for all the columns of a call, so
        columns that do not need each other belong in one.
        """
        # values may have parts of any column
        self = self._ready(*self._rows.columns)
        up_to_row = self._in_run().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self._rows.withColumns({n: FOLD[f](c).over(up_to_row) for n, (f, c) in columns.items()})
        if not self.cut:
            return self._with(rows, [*columns])
        runs_before = self._across_runs().rowsBetween(Window.unboundedPreceding, -1)
        per_run = (
            self._long(self._base)
            .groupBy(*self.keys, "_run")
            .agg(*[FOLD[f](c).alias(f"_in_{n}") for n, (f, c) in columns.items()])
        )
        earlier = per_run.select(
            *self.keys,
            "_run",
            *[FOLD[f](f"_in_{n}").over(runs_before).alias(f"_pre_{n}") for n, (f, _) in columns.items()],
        )
        rows = self._join_per_run(rows, earlier, ("_run",))
        whole = {}
        for n, (f, _) in columns.items():
            here, before = F.col(n), F.col(f"_pre_{n}")
            if f == "sum":
                whole[n] = F.coalesce(here + before, here, before)
            else:
                whole[n] = (F.least if f == "min" else F.greatest)(here, before)
        return self._with(rows.withColumns(whole).drop(*[f"_pre_{n}" for n in columns]), [*columns])

    def lagged(self, n: int, *names: str) -> OrderedGroups:
        """Add ``{name}_lag1`` to ``{name}_lag{n}``: values of the ``n`` rows before each row.

        Only the first ``n`` rows of a run look into earlier runs, and all that they can
        see is among the first and last ``n`` rows of each run.
        """
        self = self._ready(*names)
        lags = [(f"{c}_lag{i}", c, i) for c in names for i in range(1, n + 1)]
        w = self._in_run()
        rows = self._rows.withColumns({a: F.lag(c, i).over(w) for a, c, i in lags})
        if not self.cut:
            return self._with(rows, [a for a, _, _ in lags])
        # a filter on row_number keeps n rows of a run in each map task, before the shuffle
        others = sorted({*names} - {*self.order})
        wanted = self._long(self._base).select(*self._group(), *self.order, *others)
        backwards = Window.partitionBy(*self._group()).orderBy(*[F.desc(o) for o in self.order])
        firsts = wanted.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n)
        lasts = wanted.withColumn("_back", F.row_number().over(backwards)).where(F.col("_back") <= n)
        ends = (
            firsts.unionByName(lasts.drop("_back"), allowMissingColumns=True)
            .groupBy(*self._group(), *self.order)
            .agg(F.max("_nth").alias("_nth"), *[F.any_value(c).alias(c) for c in others])
        )
        in_group = Window.partitionBy(*self.keys).orderBy(*self.order)
        seen = ends.select(
            *self.keys, "_run", "_nth", *[F.lag(c, i).over(in_group).alias(f"_true_{a}") for a, c, i in lags]
        ).where(F.col("_nth") <= n)
        rows = rows.withColumn("_nth", F.row_number().over(w))
        rows = self._join_per_run(rows, seen, ("_run", "_nth"))
        first = F.col("_cut") & (F.col("_nth") <= n)
        rows = rows.withColumns({a: F.when(first, F.col(f"_true_{a}")).otherwise(F.col(a)) for a, _, _ in lags})
        return self._with(rows.drop("_nth", *[f"_true_{a}" for a, _, _ in lags]), [a for a, _, _ in lags])

    def ranked(self) -> OrderedGroups:
        """Add ``row_number``, ``rank``, ``dense_rank`` and ``group_rows``, all ``bigint``.

        Ranks compare the first column of the order; the others only break ties for
        ``row_number``. A tie may go on over several runs: its rows in a later run all
        have the rank of its first row, wherever that is.
        """
        self = self._ready(*self.order)
        added = ["row_number", "rank", "dense_rank", "group_rows"]
        value = self.order[0]
        by_value = Window.partitionBy(*self._group()).orderBy(value)
        rows = self._rows.withColumns(
            {
                "row_number": F.row_number().over(self._in_run()).cast("long"),
                "rank": F.rank().over(by_value).cast("long"),
                "dense_rank": F.dense_rank().over(by_value).cast("long"),
                "group_rows": F.count(F.lit(1)).over(Window.partitionBy(*self._group())),
            }
        )
        if not self.cut:
            return self._with(rows, added)
        by_value = self._long(self._base).groupBy(*self.keys, "_run", value).agg(F.count(F.lit(1)).alias("_c"))
        at = F.struct(value)
        per_run = (
            by_value.groupBy(*self.keys, "_run")
            .agg(
                F.sum("_c").alias("_n"),
                F.count(F.lit(1)).alias("_values"),
                F.min(at).alias("_first"),
                F.max(at).alias("_end"),
                F.max_by("_c", at).alias("_last_tie"),
            )
            .withColumn("_last_rank", F.col("_n") - F.col("_last_tie") + 1)
        )
        w = self._across_runs()
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        all_runs = Window.partitionBy(*self.keys)
        per_run = per_run.withColumns(
            {
                "_rows_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                "_goes_on": F.coalesce(F.col("_first") == F.lag("_end").over(w), F.lit(False)),
            }
        )
        one_tie = F.col("_goes_on") & (F.col("_first") == F.col("_end"))
        per_run = per_run.withColumns(
            {
                "_new_values": F.col("_values") - F.col("_goes_on").cast("int"),
                "_end_rank": F.last(
                    F.when(~one_tie, F.col("_rows_before") + F.col("_last_rank")), ignorenulls=True
                ).over(so_far),
            }
        )
        carried = per_run.select(
            *self.keys,
            "_run",
            "_rows_before",
            F.when(F.col("_goes_on"), F.lag("_end_rank").over(w)).alias("_tie_rank"),
            (F.coalesce(F.sum("_new_values").over(before), F.lit(0)) - F.col("_goes_on").cast("int")).alias(
                "_values_before"
            ),
            F.sum("_n").over(all_runs).alias("_group_rows"),
        )
        rows = self._join_per_run(rows, carried, ("_run",))
        earlier = F.coalesce("_rows_before", F.lit(0))
        in_tie = F.col("_tie_rank").isNotNull() & (F.col("rank") == 1)
        rows = rows.withColumns(
            {
                "row_number": F.col("row_number") + earlier,
                "rank": F.when(in_tie, F.col("_tie_rank")).otherwise(F.col("rank") + earlier),
                "dense_rank": F.col("dense_rank") + F.coalesce("_values_before", F.lit(0)),
                "group_rows": F.coalesce("_group_rows", "group_rows"),
            }
        )
        return self._with(rows.drop("_rows_before", "_tie_rank", "_values_before", "_group_rows"), added)
