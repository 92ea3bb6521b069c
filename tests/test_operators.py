"""Operators on small hand-made rows: boundaries, ties, repeats, nulls and hot keys."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from oracle import normal
from pyspark.sql import functions as F

from tidemark.functions import GreedyBatches, aggregate_in_batches, exact_sum, ntile_of, percent_rank_of, units
from tidemark.operators import (
    bag_difference,
    band_join,
    common_rows,
    consecutive_days,
    exact_quantiles,
    grouped_subsets,
    hop_windows,
    last_before,
    sessions,
    top_per_group,
    with_match,
    without_match,
)
from tidemark.plans import relational
from tidemark.session import shared_dir
from tidemark.sources import read_partitions, write_partitioned

START = datetime(2024, 1, 1)
SPARK_EVENTS = "user_id bigint, ts timestamp_ntz, event_id bigint, kind string"


def at(minutes, **more):
    return START + timedelta(minutes=minutes, **more)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_session_gap_of_exactly_thirty_minutes_joins(spark):
    data = [(1, at(0)), (1, at(30)), (1, at(60, microseconds=1)), (2, at(29)), (2, at(31))]
    events = spark.createDataFrame(data, "user_id bigint, ts timestamp_ntz")
    got = sessions(events, "user_id", "ts", 30, {"events": F.count(F.lit(1))})
    assert rows_of(got) == [
        (1, at(0), at(60), 2),
        (1, at(60, microseconds=1), at(90, microseconds=1), 1),
        (2, at(29), at(61), 2),
    ]


@pytest.mark.parametrize("gap", [5, 30])
def test_sessions_match_sessions_of_single_events(spark, gap):
    pick = random.Random(gap)
    data = [
        (0 if i % 3 == 0 else pick.randrange(9), at(pick.randrange(3000), seconds=pick.randrange(60)))
        for i in range(2000)
    ]
    events = spark.createDataFrame(data, "user_id bigint, ts timestamp_ntz")
    got = sessions(events, "user_id", "ts", gap, {"n": F.count(F.lit(1))})
    w = F.session_window("ts", f"{gap} minutes").alias("w")
    plain = events.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")
    assert rows_of(got) == rows_of(plain)


def test_hop_windows_match_windows_of_single_events(spark):
    pick = random.Random(3)
    data = [(pick.choice("ab"), at(pick.randrange(2000)), i) for i in range(500)]
    events = spark.createDataFrame(data, "k string, ts timestamp_ntz, v bigint")
    got = hop_windows(events, ["k"], "ts", 3, 1, {"n": F.count(F.lit(1)), "v": F.sum("v")})
    w = F.window("ts", "3 hours", "1 hour").alias("w")
    plain = events.groupBy("k", w).agg(F.count(F.lit(1)), F.sum("v")).select("k", "w.start", "w.end", "count(1)", "sum(v)")
    assert rows_of(got) == rows_of(plain)


@pytest.mark.parametrize("limits", [{}, {"run_rows": 1, "sampled_per_run": 1}])
def test_last_before_uses_ids_on_equal_times(spark, limits):
    data = [
        (1, at(0), 1, "buy"),
        (1, at(5), 2, "view"),
        (1, at(5), 3, "buy"),
        (1, at(5), 4, "view"),
        (1, at(9), 5, "other"),
        (1, at(9), 6, "buy"),
        (2, at(9), 7, "buy"),
    ]
    events = spark.createDataFrame(data, SPARK_EVENTS)
    got = last_before(
        events, ["user_id"], ["ts", "event_id"], F.col("kind") == "buy", F.col("kind") == "view", "view_", **limits
    )
    assert rows_of(got.select("event_id", "view_event_id")) == [(1, None), (3, 2), (6, 4), (7, None)]


def test_consecutive_days(spark):
    data = [(1, at(0)), (1, at(10)), (1, at(24 * 60)), (1, at(72 * 60)), (2, at(0))]
    got = consecutive_days(spark.createDataFrame(data, "u bigint, ts timestamp_ntz"), "u", "ts")
    assert rows_of(got.select("u", "days", F.col("first_day").cast("string"))) == [
        (1, 1, "2024-01-04"),
        (1, 2, "2024-01-01"),
        (2, 1, "2024-01-01"),
    ]


def test_band_join_meets_all_bands_and_edges(spark):
    values = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 9.99, 10.0, 25.0, 99.0)], "v double")
    bands = spark.createDataFrame([("a", 0.0, 10.0), ("b", 5.0, 30.0), ("c", -10.0, 100.0)], "b string, lo double, hi double")
    got = band_join(values, bands, "v", "lo", "hi", 7.0).select("v", "b")
    assert rows_of(got) == sorted(
        [(v, b) for v in (-5.0, 0.0, 9.99, 10.0, 25.0, 99.0) for b, lo, hi in
         (("a", 0, 10), ("b", 5, 30), ("c", -10, 100)) if lo <= v < hi], key=repr
    )


@pytest.mark.parametrize("block", [1, 3, 100])
def test_bag_difference_keeps_repeats(spark, block):
    left, right = ["x"] * 10 + ["y"] * 3 + ["z"] + [None] * 4, ["x"] * 3 + ["y"] * 3 + ["w"] + [None]
    one = [spark.createDataFrame([(v,) for v in side], "v string") for side in (left, right)]
    got = Counter(r[0] for r in bag_difference(*one, block=block).collect())
    assert got == Counter(left) - Counter(right)
    assert rows_of(common_rows(*one)) == rows_of(one[0].intersect(one[1]))


def test_match_and_no_match(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "a int")
    right = spark.createDataFrame([(1,)] * 50 + [(3,), (None,)], "b int")
    assert rows_of(with_match(left, right, "a", "b")) == [(1,), (3,)]
    assert rows_of(without_match(left, right, "a", "b")) == [(2,), (None,)]


def test_subsets_match_spark(spark):
    pick = random.Random(1)
    df = spark.createDataFrame([(pick.choice("ab"), pick.choice("xyz"), i) for i in range(200)], "a string, b string, v int")
    got = grouped_subsets(df, ["a", "b"], {"n": F.count(F.lit(1)), "v": F.sum("v")}, lambda d: d.cube("a", "b"))
    plain = df.cube("a", "b").agg(F.count(F.lit(1)), F.sum("v"), F.grouping_id())
    assert rows_of(got) == rows_of(plain)


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.createDataFrame([("k", i % 7, i) for i in range(100)], "k string, v int, id int")
    got = top_per_group(df, ["k"], [F.desc("v"), F.asc("id")], 2)
    assert [r.id for r in got.orderBy("place").collect()] == [6, 13]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize("limits", [{}, {"run_rows": 20, "sampled_per_run": 10}])
def test_quantiles_of_large_and_small_groups(spark, limits):
    """One group is large enough for slices, and much of it is one value."""
    pick = random.Random(9)
    groups = {
        "large": [pick.gauss(0, 100) for _ in range(30_000)],
        "tied": [5.0] * 12_000 + [pick.uniform(0, 10) for _ in range(9_000)],
        "small": [3.0, 1.0, 2.0, 2.0],
        "one": [4.5],
        None: [1.0, 2.0, 4.0],
    }
    data = [(k, v) for k, vs in groups.items() for v in vs] + [("small", None)]
    df = spark.createDataFrame(data, "k string, v double")
    wanted = {"low": 0.0, "q": 0.25, "mid": 0.5, "top": 0.999, "high": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", wanted, **limits).collect()}
    for k, vs in groups.items():
        for name, p in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), abs=1e-9), (k, name)


def test_ntile_and_percent_rank(spark):
    for size in (1, 2, 3, 7, 8):
        df = spark.range(1, size + 1).withColumn("n", F.lit(size))
        got = df.select("id", ntile_of(F.col("id"), F.col("n"), 3), percent_rank_of(F.col("id"), F.col("n")))
        expected = spark.sql(
            f"select id, cast(ntile(3) over (order by id) as bigint), percent_rank() over (order by id) from range(1, {size + 1})"
        )
        assert rows_of(got) == rows_of(expected)


def test_exact_sum_takes_negative_and_large_amounts(spark):
    amounts = [0.1] * 10 + [-0.3, 12345678.91, -99999999.99, 0.01]
    df = spark.createDataFrame([(a,) for a in amounts], "a double").repartition(4)
    got = df.agg(exact_sum(units("a")).alias("s")).first().s
    assert str(got) == "-87654320.37"


def test_written_partitions_are_skipped_and_hot_ones_split(spark):
    path = shared_dir(spark, "partitions")
    ids = spark.range(0, 60_000, numPartitions=6)
    df = ids.withColumn("y", F.when(F.col("id") % 3 == 0, 100).otherwise(F.col("id") % 97))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "20KB")
    try:
        write_partitioned(df, path, "y")
    finally:
        spark.conf.unset(size)
    back = read_partitions(spark, path, F.col("y") == 100)
    assert back.count() == df.where("y = 100").count()
    assert "PartitionFilters: [isnotnull(y" in back._jdf.queryExecution().executedPlan().toString()
    files = spark.read.parquet(path).select("y", F.input_file_name().alias("file")).groupBy("y")
    per_value = {r.y: r.n for r in files.agg(F.countDistinct("file").alias("n")).collect()}
    assert per_value[100] > 1


def test_aggregate_in_batches_merges_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
        got = aggregate_in_batches(
            df,
            ["k"],
            lambda part: {"n": float(len(part)), "low": part["v"].min(), "high": part["v"].max()},
            {"n": "sum", "low": "min", "high": "max"},
        )
        assert rows_of(got) == [(0, 334.0, 0.0, 999.0), (1, 333.0, 1.0, 997.0), (2, 333.0, 2.0, 998.0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_estimates_are_near_the_exact_values(spark, data_dir):
    exact, near = ({r.o_orderpriority: r.customers for r in relational.QUERIES[n](spark, data_dir).collect()} for n in ("customers_by_priority", "approx_customers_by_priority"))
    assert exact.keys() == near.keys() and all(abs(near[k] - exact[k]) <= 0.05 * exact[k] for k in exact)
    prices = {}
    for r in spark.read.parquet(f"{data_dir}/orders.parquet").select("o_orderpriority", "o_totalprice").collect():
        prices.setdefault(r.o_orderpriority, []).append(r.o_totalprice)
    for r in relational.QUERIES["approx_price_quantiles_by_priority"](spark, data_dir).collect():
        mine = prices[r.o_orderpriority]
        for name, p in relational.QUANTILES.items():
            below, upto = (sum(x < r[name] for x in mine) / len(mine), sum(x <= r[name] for x in mine) / len(mine))
            assert below - 0.02 <= p <= upto + 0.02


def test_price_estimates_are_checked_and_equal_their_sql(spark, tmp_path):
    """Ranks at a group's ends, ties, nulls, and prices of few digits, none and below nothing."""
    rng = random.Random(8)
    prices = {f"p{n}": [round(10 ** rng.uniform(0, 7), 2) for _ in range(n)] for n in range(1, 42)}
    prices |= {"ties": [99.95] * 30 + [99.96] * 30, "none": [None, None], "some": [None, 10004.99, None], None: [5.0, 9995.0, 0.0], "back": [-1234.56, -1.0, 0.01]}
    rows = [(i, k, x) for i, (k, x) in enumerate((k, x) for k, mine in prices.items() for x in mine)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderpriority string, o_totalprice double").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    query = relational.QUERIES["approx_price_quantiles_by_priority"]
    got = query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    asked = con.execute(query.sql)
    names = [d[0] for d in asked.description]
    expected = asked.fetchall()
    assert normal(got.columns, [tuple(r) for r in got.collect()]) == normal(names, expected)
    found = {r.o_orderpriority: r for r in got.collect()}
    assert {k: r.orders for k, r in found.items()} == {k: len(mine) for k, mine in prices.items()}
    for k, mine in prices.items():
        mine = sorted(x for x in mine if x is not None)
        for name, percent in (("median", 50), ("p90", 90)):
            if mine:
                exact = mine[-(-len(mine) * percent // 100) - 1]
                assert found[k][f"{name}_within_error"] and abs(found[k][name] - exact) <= 0.00501 * abs(exact)
            else:
                assert found[k][name] is None and found[k][f"{name}_within_error"] is None


def test_large_keys_beside_a_null_stay_apart(spark):
    df = spark.createDataFrame([(2**53, 1.0), (2**53 + 1, 2.0), (None, 4.0), (2**53 + 1, 8.0)], "k bigint, v double")
    got = aggregate_in_batches(df, ["k"], lambda part: {"total": part["v"].sum()}, {"total": "sum"})
    assert {tuple(r) for r in got.collect()} == {(2**53, 1.0), (2**53 + 1, 10.0), (None, 4.0)}


def test_open_bands(spark):
    values = spark.createDataFrame([(-5.0,), (0.0,), (9.9,), (10.0,), (35.0,), (1e12,), (None,)], "v double")
    bands = spark.createDataFrame([("low", None, 10.0), ("middle", 10.0, 30.0), ("high", 30.0, None), ("all", None, None)], "band string, low double, high double")
    got = {}
    for r in band_join(values, bands, "v", "low", "high", 10.0).collect():
        got.setdefault(r.band, []).append(r.v)
    assert {b: sorted(v) for b, v in got.items()} == {
        "low": [-5.0, 0.0, 9.9], "middle": [10.0], "high": [35.0, 1e12], "all": [-5.0, 0.0, 9.9, 10.0, 35.0, 1e12],
    }


def test_windows_that_are_no_multiple_of_their_hop_are_an_error(spark):
    with pytest.raises(ValueError, match="multiple"):
        hop_windows(spark.range(0), [], "id", 3, 2, {})


def test_greedy_batches(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([1, 5, 9, 30, None])) for i in range(120)] + [(3, 500, 100)]
    df = spark.createDataFrame(rows, "k bigint, at bigint, amount bigint").selectExpr("k", "at", "amount", "cast(at as string) as name").repartition(5)
    expected = []
    for k in (1, 2, 3, None):
        batches: list[list] = []
        for _, i, amount in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if batches and batches[-1][1] + (amount or 0) <= 20:
                batches[-1][0] += 1
                batches[-1][1] += amount or 0
                batches[-1][3] = str(i)
            else:
                batches.append([1, amount or 0, str(i), str(i)])
        expected += [(n, *b) for n, b in enumerate(batches)]
    got = GreedyBatches(df.asTable().partitionBy("k").orderBy("at"), F.lit(20)).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
