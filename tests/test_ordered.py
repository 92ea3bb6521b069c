"""Groups cut in runs give what Spark's plain windows give, wherever the cuts fall."""

import random

import pytest
from oracle import normal, run_sql
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import OrderedGroups
from tidemark.operators.ordered import find_cuts
from tidemark.plans import QUERIES, events, relational

LIMITS = [
    {"run_rows": 4, "sampled_per_run": 4},
    {"run_rows": 9, "sampled_per_run": 2},
    {"run_rows": 1, "sampled_per_run": 1},
    {"run_rows": 40, "sampled_per_run": 10, "max_runs": 5},
]


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows under one key, long ties, and nulls in keys, order and values."""
    pick = random.Random(5)
    data = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else pick.choice(["a", "b", None] + [f"k{n}" for n in range(40)])
        value = pick.choice([7, 7, 7, None, *range(0, 20, 3)])
        data.append((key, value, i, None if pick.random() < 0.2 else pick.randint(-50, 50)))
    pick.shuffle(data)
    return spark.createDataFrame(data, "k string, v int, id int, x int").repartition(5, "id").cache()


def same(got, expected):
    assert sorted(map(repr, got.select(sorted(got.columns)).collect())) == sorted(
        map(repr, expected.select(sorted(expected.columns)).collect())
    )


@pytest.mark.parametrize("limits", LIMITS)
def test_running(rows, limits):
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    groups = OrderedGroups(rows, ["k"], ["v", "id"], **limits)
    assert groups.cut
    got = groups.running(total=("sum", F.col("x")), low=("min", F.col("x")), high=("max", F.struct("x", "id"))).df()
    same(
        got,
        rows.withColumns(
            {"total": F.sum("x").over(w), "low": F.min("x").over(w), "high": F.max(F.struct("x", "id")).over(w)}
        ),
    )


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("n", [1, 3])
def test_lagged(rows, limits, n):
    w = Window.partitionBy("k").orderBy("v", "id")
    got = OrderedGroups(rows, ["k"], ["v", "id"], **limits).lagged(n, "x", "id").df()
    expected = rows
    for c in ("x", "id"):
        for i in range(1, n + 1):
            expected = expected.withColumn(f"{c}_lag{i}", F.lag(c, i).over(w))
    same(got, expected)


@pytest.mark.parametrize("limits", LIMITS)
def test_ranked(rows, limits):
    w, ties = Window.partitionBy("k").orderBy("v", "id"), Window.partitionBy("k").orderBy("v")
    got = OrderedGroups(rows, ["k"], ["v", "id"], **limits).ranked().df()
    same(
        got,
        rows.withColumns(
            {
                "row_number": F.row_number().over(w).cast("long"),
                "rank": F.rank().over(ties).cast("long"),
                "dense_rank": F.dense_rank().over(ties).cast("long"),
                "group_rows": F.count(F.lit(1)).over(Window.partitionBy("k")),
            }
        ),
    )


def test_steps_can_follow_each_other(rows):
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    got = (
        OrderedGroups(rows, ["k"], ["v", "id"], run_rows=5, sampled_per_run=5)
        .running(a=("sum", F.col("v")))
        .running(b=("max", F.col("a")))
        .lagged(1, "a")
        .df()
    )
    plain = rows.withColumn("a", F.sum("v").over(w))
    plain = plain.withColumn("b", F.max("a").over(w))
    same(got, plain.withColumn("a_lag1", F.lag("a").over(Window.partitionBy("k").orderBy("v", "id"))))


def test_cuts_are_few_and_only_in_long_groups(rows):
    cuts = find_cuts(rows, ["k"], ["v", "id"], run_rows=50, sampled_per_run=50)
    assert 0 < len(cuts) <= 600 / 50
    assert {c["k"] for c in cuts} == {"hot"}
    assert find_cuts(rows, ["k"], ["v", "id"], run_rows=1, sampled_per_run=1, max_runs=10) != []
    assert find_cuts(rows, ["k"], ["v", "id"]) == []
    assert find_cuts(rows, ["k"], ["v", "id"], longest_group=600) == []


def test_what_gives_the_rows_is_read_once(spark, rows, tmp_path):
    """Neither the source nor an earlier step is worked out again, however many steps follow."""
    rows.write.parquet(f"{tmp_path}/source")
    reads = []
    groups = OrderedGroups(spark.read.parquet(f"{tmp_path}/source"), ["k"], ["v", "id"], run_rows=5, sampled_per_run=5)
    column = "x"
    for step in range(4):
        groups = groups.running(**{f"s{step}": ("max", F.col(column))}).lagged(1, "id")
        column = f"s{step}"
        assert not any("/source/" in f for f in groups.df().inputFiles())
        reads.append(groups.df()._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
    # the rows, their sums per run, the first and the last rows of each run
    assert reads == [4] * 4


FORCED = {"longest_group": None, "run_rows": 6, "sampled_per_run": 3}


@pytest.mark.parametrize(
    ("name", "build"),
    [
        ("order_history", relational.order_history),
        ("part_price_ranks", relational.part_price_ranks),
        ("price_quantiles_by_priority", relational.price_quantiles_by_priority),
        ("view_before_purchase", events.view_before_purchase),
        ("purchases_soon_after_view", events.purchases_soon_after_view),
        ("funnel", events.funnel),
    ],
)
def test_queries_with_groups_cut(spark, data_dir, name, build):
    got = build(spark, data_dir, **FORCED)
    names, _, expected = run_sql(QUERIES[name].sql, data_dir)
    assert normal(got.columns, [tuple(r) for r in got.collect()]) == normal(names, expected)
