"""Queries that would once have called Python functions, in the built-in ones that say the same, and one by a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import GreedyBatches
from tidemark.plans.registry import Query
from tidemark.sources import table


def price_first_digits(spark: SparkSession, data_dir: str) -> DataFrame:
    """Orders counted by the first digit of their price."""
    whole = F.floor("o_totalprice").cast("string")
    digit = F.left(whole, F.lit(1)).cast("bigint").alias("digit")
    return table(spark, data_dir, "orders").groupBy(digit).agg(F.count(F.lit(1)).alias("orders"))


PRICE_FIRST_DIGITS_SQL = """
select cast(left(cast(cast(floor(o_totalprice) as bigint) as varchar), 1) as bigint) as digit, count(*) as orders
from orders group by 1
"""


def geometric_mean_price(spark: SparkSession, data_dir: str) -> DataFrame:
    """Geometric mean of the order price per priority. Logarithms are summed as whole numbers
    of 10^-12, so the order of the rows makes no difference."""
    log = F.round(F.ln("o_totalprice") * 1e12).cast("decimal(20,0)")
    n = F.count("o_totalprice")
    mean = F.exp(F.sum(log).cast("double") / n / 1e12)
    return table(spark, data_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.round(mean, 4).alias("geometric_mean")
    )


GEOMETRIC_MEAN_PRICE_SQL = """
select o_orderpriority, count(*) as orders, round(exp(avg(ln(o_totalprice))), 4) as geometric_mean
from orders group by o_orderpriority
"""


def daily_trend_by_user(spark: SparkSession, data_dir: str) -> DataFrame:
    """Slope of each user's events per day."""
    start = F.lit("2024-01-01").cast("date")
    days = (
        table(spark, data_dir, "events")
        .groupBy("user_id", F.date_diff(F.to_date("ts"), start).alias("day"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return days.groupBy("user_id").agg(F.round(F.regr_slope("events", "day"), 9).alias("slope"))


DAILY_TREND_SQL = """
select user_id, round(regr_slope(events, day), 9) as slope
from (select user_id, cast(ts as date) - date '2024-01-01' as day, count(*) as events from events group by 1, 2)
group by user_id
"""


def name_words_by_position(spark: SparkSession, data_dir: str) -> DataFrame:
    """Words of part names counted by place."""
    words = F.posexplode(F.split(F.lower("p_name"), " ")).alias("place", "word")
    placed = table(spark, data_dir, "part").select(words).withColumn("position", (F.col("place") + 1).cast("bigint"))
    return placed.groupBy("position", "word").agg(F.count(F.lit(1)).alias("parts"))


NAME_WORDS_SQL = """
select position, word, count(*) as parts
from (select unnest(w) as word, generate_subscripts(w, 1) as position
      from (select string_split(lower(p_name), ' ') as w from part))
group by position, word
"""


BATCH_CENTS = 50_000_000


def order_batches(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each customer's orders of a year, by date, in batches of at most half a million."""
    orders = table(spark, data_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("order_year"), "o_orderdate", "o_orderkey",
        F.col("o_orderkey").cast("string").alias("name"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"),
    )
    parts = orders.asTable().partitionBy("o_custkey", "order_year").orderBy("o_orderdate", "o_orderkey")
    found = GreedyBatches(parts, F.lit(BATCH_CENTS))
    return found.select(F.col("first").cast("bigint").alias("first_order"), F.col("last").cast("bigint").alias("last_order"), "batch", F.col("rows").alias("orders"), (F.col("total") / 100).alias("total"))


ORDER_BATCHES_SQL = f"""
with recursive o as (
  select o_custkey, year(o_orderdate) as y, o_orderkey, round(o_totalprice * 100)::bigint as cents,
         row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey) as i
  from orders
), b as (
  select o_custkey, y, i, o_orderkey, cents, cents as running, 0 as batch from o where i = 1
  union all
  select o.o_custkey, o.y, o.i, o.o_orderkey, o.cents, case when running + o.cents > {BATCH_CENTS} then o.cents else running + o.cents end,
         batch + (running + o.cents > {BATCH_CENTS})::integer
  from b join o on o.o_custkey = b.o_custkey and o.y = b.y and o.i = b.i + 1
)
select first(o_orderkey order by i) as first_order, last(o_orderkey order by i) as last_order, batch, count(*) as orders, sum(cents)::bigint / 100 as total
from b group by o_custkey, y, batch
"""


QUERIES = {
    "order_batches": Query(order_batches, ORDER_BATCHES_SQL),
    "price_first_digits": Query(price_first_digits, PRICE_FIRST_DIGITS_SQL),
    "geometric_mean_price": Query(geometric_mean_price, GEOMETRIC_MEAN_PRICE_SQL),
    "daily_trend_by_user": Query(daily_trend_by_user, DAILY_TREND_SQL),
    "name_words_by_position": Query(name_words_by_position, NAME_WORDS_SQL),
}
