"""Queries over the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import (
    as_double,
    exact,
    exact_sum,
    merged_sums,
    named,
    ntile_of,
    part_sums,
    percent_rank_of,
    sum_of,
    units,
)
from tidemark.operators import (
    OrderedGroups,
    bag_difference,
    band_join,
    common_rows,
    exact_quantiles,
    grouped_subsets,
    top_per_group,
    with_match,
    without_match,
)
from tidemark.plans.registry import Query
from tidemark.session import shared_dir
from tidemark.sources import read_partitions, table, write_partitioned


def _count():
    return F.count(F.lit(1))


def _discounted():
    """Price less discount, in units of the fourth place."""
    return units("l_extendedprice") * (F.lit(100) - units("l_discount"))


def _taxed():
    """That with tax, in units of the sixth place."""
    return _discounted() * (F.lit(100) + units("l_tax"))


SQL_PRICE = "cast(l_extendedprice as decimal(12,2))"
SQL_DISCOUNTED = f"{SQL_PRICE} * (1 - cast(l_discount as decimal(3,2)))"
SQL_TAXED = f"{SQL_DISCOUNTED} * (1 + cast(l_tax as decimal(3,2)))"


def _money(expression: str, places: int = 2) -> str:
    return f"cast(round({expression}, {places}) as double)"


def pricing_summary(spark: SparkSession, data_dir: str) -> DataFrame:
    """Sums and averages by return flag and line status, shipped up to a date."""
    lines = table(spark, data_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    sums = lines.groupBy("l_returnflag", "l_linestatus").agg(
        exact_sum(units("l_quantity")).alias("qty"),
        exact_sum(units("l_extendedprice")).alias("price"),
        exact_sum(_discounted(), 4).alias("discounted"),
        exact_sum(_taxed(), 6).alias("taxed"),
        exact_sum(units("l_discount")).alias("discount"),
        _count().alias("count_order"),
    )

    def mean(c: str):
        return F.round(F.col(c).cast("double") / F.col("count_order"), 6)

    return sums.select(
        "l_returnflag",
        "l_linestatus",
        as_double("qty").alias("sum_qty"),
        as_double("price").alias("sum_base_price"),
        as_double("discounted").alias("sum_disc_price"),
        as_double("taxed").alias("sum_charge"),
        mean("qty").alias("avg_qty"),
        mean("price").alias("avg_price"),
        mean("discount").alias("avg_disc"),
        "count_order",
    )


PRICING_SUMMARY_SQL = f"""
select l_returnflag, l_linestatus,
       {_money("sum(cast(l_quantity as decimal(12,2)))")} as sum_qty,
       {_money(f"sum({SQL_PRICE})")} as sum_base_price,
       {_money(f"sum({SQL_DISCOUNTED})")} as sum_disc_price,
       {_money(f"sum({SQL_TAXED})")} as sum_charge,
       round(cast(sum(cast(l_quantity as decimal(12,2))) as double) / count(*), 6) as avg_qty,
       round(cast(sum({SQL_PRICE}) as double) / count(*), 6) as avg_price,
       round(cast(sum(cast(l_discount as decimal(3,2))) as double) / count(*), 6) as avg_disc,
       count(*) as count_order
from lineitem
where l_shipdate <= timestamp '1998-09-02'
group by l_returnflag, l_linestatus
"""


def _nation_revenue(spark: SparkSession, data_dir: str) -> DataFrame:
    """Revenue per customer nation.

    Lines are summed per order and orders per customer before each join, so a very large
    order or customer is one row by the time it is joined.
    """
    per_order = table(spark, data_dir, "lineitem").groupBy("l_orderkey").agg(*named(part_sums("revenue", _discounted())))
    orders = table(spark, data_dir, "orders").select("o_orderkey", "o_custkey")
    per_customer = (
        orders.join(per_order, orders.o_orderkey == per_order.l_orderkey)
        .groupBy("o_custkey")
        .agg(*named(merged_sums("revenue")))
    )
    customers = table(spark, data_dir, "customer").select("c_custkey", "c_nationkey")
    per_nation = (
        customers.join(per_customer, customers.c_custkey == per_customer.o_custkey)
        .groupBy("c_nationkey")
        .agg(*named(merged_sums("revenue")))
    )
    nations = table(spark, data_dir, "nation")
    regions = table(spark, data_dir, "region")
    return per_nation.join(nations, per_nation.c_nationkey == nations.n_nationkey).join(
        regions, nations.n_regionkey == regions.r_regionkey
    )


SQL_SALES = """
from lineitem
join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey
join region on n_regionkey = r_regionkey
"""


def revenue_by_region(spark: SparkSession, data_dir: str) -> DataFrame:
    by_region = _nation_revenue(spark, data_dir).groupBy("r_name").agg(*named(merged_sums("revenue")))
    return by_region.select("r_name", as_double(sum_of("revenue", 4)).alias("revenue"))


REVENUE_BY_REGION_SQL = f"""
select r_name, {_money(f"sum({SQL_DISCOUNTED})")} as revenue {SQL_SALES} group by r_name
"""


def revenue_rollup(spark: SparkSession, data_dir: str) -> DataFrame:
    """Revenue per nation, per region and in all."""
    out = grouped_subsets(
        _nation_revenue(spark, data_dir),
        ["r_name", "n_name"],
        merged_sums("revenue"),
        lambda d: d.rollup("r_name", "n_name"),
    )
    return out.select("r_name", "n_name", "grouping_id", as_double(sum_of("revenue", 4)).alias("revenue"))


REVENUE_ROLLUP_SQL = f"""
select r_name, n_name, cast(grouping_id(r_name, n_name) as bigint) as grouping_id,
       {_money(f"sum({SQL_DISCOUNTED})")} as revenue
{SQL_SALES} group by rollup (r_name, n_name)
"""


def top_customers(spark: SparkSession, data_dir: str) -> DataFrame:
    """The ten customers that spent most; names are looked up for those ten only."""
    top = (
        table(spark, data_dir, "orders")
        .groupBy("o_custkey")
        .agg(exact_sum(units("o_totalprice")).alias("spend"), _count().alias("orders"))
        .orderBy(F.desc("spend"), "o_custkey")
        .limit(10)
    )
    customers = table(spark, data_dir, "customer").select("c_custkey", "c_name")
    # ten rows, by the limit above
    named = customers.join(F.broadcast(top), customers.c_custkey == top.o_custkey)
    return named.select("c_custkey", "c_name", as_double("spend").alias("spend"), "orders")


TOP_CUSTOMERS_SQL = f"""
select c_custkey, c_name, {_money("sum(cast(o_totalprice as decimal(12,2)))")} as spend, count(*) as orders
from orders join customer on o_custkey = c_custkey
group by c_custkey, c_name
order by sum(cast(o_totalprice as decimal(12,2))) desc, c_custkey limit 10
"""


def flag_status_cube(spark: SparkSession, data_dir: str) -> DataFrame:
    out = grouped_subsets(
        table(spark, data_dir, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {"lines": _count(), **part_sums("quantity", units("l_quantity"))},
        lambda d: d.cube("l_returnflag", "l_linestatus"),
    )
    quantity = as_double(sum_of("quantity")).alias("quantity")
    return out.select("l_returnflag", "l_linestatus", "grouping_id", "lines", quantity)


FLAG_STATUS_CUBE_SQL = f"""
select l_returnflag, l_linestatus, cast(grouping_id(l_returnflag, l_linestatus) as bigint) as grouping_id,
       count(*) as lines, {_money("sum(cast(l_quantity as decimal(12,2)))")} as quantity
from lineitem group by cube (l_returnflag, l_linestatus)
"""


def order_grouping_sets(spark: SparkSession, data_dir: str) -> DataFrame:
    """Orders counted by status, by priority, and in all."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return grouped_subsets(
        table(spark, data_dir, "orders"),
        ["o_orderstatus", "o_orderpriority"],
        {"orders": _count()},
        lambda d: d.groupingSets([[status], [priority], []], status, priority),
    )


ORDER_GROUPING_SETS_SQL = """
select o_orderstatus, o_orderpriority, count(*) as orders,
       cast(grouping_id(o_orderstatus, o_orderpriority) as bigint) as grouping_id
from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())
"""


def largest_orders_per_customer(spark: SparkSession, data_dir: str) -> DataFrame:
    """The three largest orders of each customer."""
    orders = table(spark, data_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return top.withColumn("place", F.col("place").cast("long"))


LARGEST_ORDERS_SQL = """
select o_custkey, o_orderkey, o_totalprice, place from (
  select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders)
where place <= 3
"""


def order_history(spark: SparkSession, data_dir: str, **limits) -> DataFrame:
    """Each order with the customer's running total, last-three average and previous order."""
    table_ = table(spark, data_dir, "orders")
    orders = table_.select("o_custkey", "o_orderdate", "o_orderkey", exact("o_totalprice").alias("price"))
    if "longest_group" not in limits:
        limits["longest_group"] = table_.count()
    out = (
        OrderedGroups(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], **limits)
        .running(total=("sum", F.col("price")))
        .lagged(2, "price", "o_orderkey")
        .df()
    )
    none = F.lit(0).cast("decimal(12,2)")
    recent = F.col("price") + F.coalesce("price_lag1", none) + F.coalesce("price_lag2", none)
    seen = F.lit(1) + F.col("price_lag1").isNotNull().cast("int") + F.col("price_lag2").isNotNull().cast("int")
    return out.select(
        "o_custkey",
        "o_orderkey",
        as_double("total").alias("running_total"),
        F.round(recent.cast("double") / seen, 6).alias("moving_average"),
        F.col("o_orderkey_lag1").alias("previous_order"),
    )


ORDER_HISTORY_SQL = f"""
select o_custkey, o_orderkey,
       {_money("sum(price) over (w rows unbounded preceding)")} as running_total,
       round(cast(sum(price) over (w rows 2 preceding) as double) / count(*) over (w rows 2 preceding), 6)
         as moving_average,
       lag(o_orderkey) over w as previous_order
from (select *, cast(o_totalprice as decimal(12,2)) as price from orders)
window w as (partition by o_custkey order by o_orderdate, o_orderkey)
"""


def part_price_ranks(spark: SparkSession, data_dir: str, **limits) -> DataFrame:
    """Rank, dense rank, quartile and percent rank of each part's price in its brand."""
    parts = table(spark, data_dir, "part")
    if "longest_group" not in limits:
        limits["longest_group"] = parts.count()
    ranked = (
        OrderedGroups(
            parts.select("p_brand", "p_retailprice", "p_partkey"),
            ["p_brand"],
            ["p_retailprice", "p_partkey"],
            **limits,
        )
        .ranked()
        .df()
    )
    return ranked.select(
        "p_brand",
        "p_partkey",
        F.col("rank").alias("price_rank"),
        F.col("dense_rank").alias("price_dense_rank"),
        ntile_of(F.col("row_number"), F.col("group_rows"), 4).alias("quartile"),
        F.round(percent_rank_of(F.col("rank"), F.col("group_rows")), 9).alias("price_percent_rank"),
    )


PART_PRICE_RANKS_SQL = """
select p_brand, p_partkey,
       rank() over w as price_rank,
       dense_rank() over w as price_dense_rank,
       ntile(4) over (partition by p_brand order by p_retailprice, p_partkey) as quartile,
       round(percent_rank() over w, 9) as price_percent_rank
from part window w as (partition by p_brand order by p_retailprice)
"""


def big_spenders(spark: SparkSession, data_dir: str) -> DataFrame:
    """Customers with an order over 490,000."""
    large = table(spark, data_dir, "orders").where(F.col("o_totalprice") > 490_000)
    customers = table(spark, data_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return with_match(customers, large, "c_custkey", "o_custkey")


BIG_SPENDERS_SQL = """
select c_custkey, c_name, c_mktsegment from customer
where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 490000)
"""


def _in_year(column: str, year: int):
    """A year as a range of times, which the Parquet reader can skip row groups by."""
    start = F.lit(f"{year}-01-01").cast("timestamp_ntz")
    end = F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
    return (F.col(column) >= start) & (F.col(column) < end)


def idle_customers(spark: SparkSession, data_dir: str) -> DataFrame:
    """Customers with no order in 1996."""
    active = table(spark, data_dir, "orders").where(_in_year("o_orderdate", 1996))
    customers = table(spark, data_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return without_match(customers, active, "c_custkey", "o_custkey")


IDLE_CUSTOMERS_SQL = """
select c_custkey, c_name, c_mktsegment from customer
where not exists (select 1 from orders where o_custkey = c_custkey and year(o_orderdate) = 1996)
"""


def nation_parties(spark: SparkSession, data_dir: str) -> DataFrame:
    """Customers and suppliers of every nation, each side counted before it is joined."""
    customers = table(spark, data_dir, "customer").groupBy("c_nationkey").agg(_count().alias("customers"))
    suppliers = table(spark, data_dir, "supplier").groupBy("s_nationkey").agg(_count().alias("suppliers"))
    return (
        table(spark, data_dir, "nation")
        .join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .select(
            "n_name",
            F.coalesce("customers", F.lit(0)).alias("customers"),
            F.coalesce("suppliers", F.lit(0)).alias("suppliers"),
        )
    )


NATION_PARTIES_SQL = """
select n_name,
       (select count(*) from customer where c_nationkey = n_nationkey) as customers,
       (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers
from nation
"""


def _shipped_in(spark: SparkSession, data_dir: str, year: int) -> DataFrame:
    return table(spark, data_dir, "lineitem").where(_in_year("l_shipdate", year)).select("l_partkey")


def parts_in_both_years(spark: SparkSession, data_dir: str) -> DataFrame:
    """Parts shipped in 1996 and in 1997."""
    return common_rows(_shipped_in(spark, data_dir, 1996), _shipped_in(spark, data_dir, 1997))


PARTS_IN_BOTH_YEARS_SQL = """
select l_partkey from lineitem where year(l_shipdate) = 1996
intersect
select l_partkey from lineitem where year(l_shipdate) = 1997
"""


def part_shipments_difference(spark: SparkSession, data_dir: str) -> DataFrame:
    """Parts shipped in 1996 less those shipped in 1997, with repeats kept."""
    return bag_difference(_shipped_in(spark, data_dir, 1996), _shipped_in(spark, data_dir, 1997))


PART_SHIPMENTS_DIFFERENCE_SQL = """
select l_partkey from lineitem where year(l_shipdate) = 1996
except all
select l_partkey from lineitem where year(l_shipdate) = 1997
"""


def customers_by_priority(spark: SparkSession, data_dir: str) -> DataFrame:
    return table(spark, data_dir, "orders").groupBy("o_orderpriority").agg(
        F.countDistinct("o_custkey").alias("customers")
    )


CUSTOMERS_BY_PRIORITY_SQL = """
select o_orderpriority, count(distinct o_custkey) as customers from orders group by o_orderpriority
"""


#: Of the sketch: 2^12 registers, a standard error of some 1.6 %.
LG_REGISTERS = 12


def approx_customers_by_priority(spark: SparkSession, data_dir: str) -> DataFrame:
    """About how many customers there are per priority, from one pass over the orders. Each priority and
    year has a sketch of its own; merged, they say how many there are in all years."""
    orders = table(spark, data_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
    years = orders.groupBy("o_orderpriority", "order_year").agg(F.hll_sketch_agg("o_custkey", LG_REGISTERS).alias("sketch"))
    return years.groupBy("o_orderpriority").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("customers"))


QUANTILES = {"median": 0.5, "p90": 0.9}


def price_quantiles_by_priority(spark: SparkSession, data_dir: str, **limits) -> DataFrame:
    """Exact median and 90th percentile of the order price."""
    orders = table(spark, data_dir, "orders")
    if "longest_group" not in limits:
        limits["longest_group"] = orders.count()
    found = exact_quantiles(orders, ["o_orderpriority"], "o_totalprice", QUANTILES, **limits)
    return found.select("o_orderpriority", *[F.round(n, 4).alias(n) for n in QUANTILES])


PRICE_QUANTILES_SQL = """
select o_orderpriority,
       round(quantile_cont(o_totalprice, 0.5), 4) as median,
       round(quantile_cont(o_totalprice, 0.9), 4) as p90
from orders group by o_orderpriority
"""


#: Digits of a price that are kept for estimates. With three, a value is off by 0.5 % at most.
DIGITS, OFF = 3, 5


def approx_price_quantiles_by_priority(spark: SparkSession, data_dir: str) -> DataFrame:
    """About the median and the 90th percentile of the order price, how many orders there are, and
    whether the estimates are within 0.5 % of the exact values.

    Prices are counted by their first three digits, which is some 900 counts for each power of ten, however
    many orders there are. A second pass over the orders counts those below and up to what an
    estimate may stand for, which says where the exact value is without putting prices in order.
    """
    orders = table(spark, data_dir, "orders").select("o_orderpriority", units("o_totalprice").alias("cents"))
    step = F.expr(f"cast(pow(10, greatest(length(cast(abs(cents) as string)) - {DIGITS}, 0)) as bigint)")
    near = F.expr("cast(sign(cents) as bigint) * ((abs(cents) + step div 2) div step * step)")
    counts = orders.withColumn("step", step).groupBy("o_orderpriority", near.alias("near")).agg(_count().alias("n"))
    priced = F.when(F.col("near").isNotNull(), F.col("n"))
    group = Window.partitionBy("o_orderpriority")
    ranked = counts.withColumns({"upto": F.sum(priced).over(group.orderBy("near")), "priced": F.sum(priced).over(group)})
    percent = {n: F.col("priced") * round(100 * p) for n, p in QUANTILES.items()}
    found = ranked.groupBy(F.col("o_orderpriority").alias("of"), "priced").agg(
        F.sum("n").alias("orders"), *[F.min(F.when(F.col("upto") * 100 >= at, F.col("near"))).alias(n) for n, at in percent.items()]
    )
    over, slack = {n: (F.col(n) - F.col("cents")) * 1000 for n in QUANTILES}, F.abs("cents") * OFF
    checked = orders.join(found, F.col("o_orderpriority").eqNullSafe(F.col("of"))).groupBy("o_orderpriority", "orders", "priced", *QUANTILES).agg(
        *[F.count(F.when(over[n] > slack, 1)).alias(f"below_{n}") for n in QUANTILES],
        *[F.count(F.when(-over[n] <= slack, 1)).alias(f"upto_{n}") for n in QUANTILES],
    )
    return checked.select(
        "o_orderpriority",
        "orders",
        *[(F.col(n) / F.lit(100.0)).alias(n) for n in QUANTILES],
        *[((F.col(f"below_{n}") * 100 < at) & (F.col(f"upto_{n}") * 100 >= at)).alias(f"{n}_within_error") for n, at in percent.items()],
    )


APPROX_PRICE_QUANTILES_SQL = f"""
with cents as (
  select o_orderpriority, cast(round(o_totalprice * 100) as bigint) as exact from orders
), steps as (
  select *, cast(pow(10, greatest(length(cast(abs(exact) as varchar)) - {DIGITS}, 0)) as bigint) as step from cents
), nears as (
  select *, sign(exact) * ((abs(exact) + step // 2) // step * step) as near from steps
)
select o_orderpriority, count(*) as orders,
       quantile_disc(near, 0.5) / 100 as median,
       quantile_disc(near, 0.9) / 100 as p90,
       abs(quantile_disc(near, 0.5) - quantile_disc(exact, 0.5)) * 1000 <= {OFF} * abs(quantile_disc(exact, 0.5)) as median_within_error,
       abs(quantile_disc(near, 0.9) - quantile_disc(exact, 0.9)) * 1000 <= {OFF} * abs(quantile_disc(exact, 0.9)) as p90_within_error
from nears group by o_orderpriority
"""


STATUSES = ["F", "O", "P"]


def status_pivot(spark: SparkSession, data_dir: str) -> DataFrame:
    """Orders per priority, a column per status. Listing the statuses saves a pass to find them."""
    orders = table(spark, data_dir, "orders")
    return orders.groupBy("o_orderpriority").pivot("o_orderstatus", STATUSES).agg(F.count("o_orderkey")).na.fill(0)


STATUS_PIVOT_SQL = """
select o_orderpriority,
       count(*) filter (where o_orderstatus = 'F') as "F",
       count(*) filter (where o_orderstatus = 'O') as "O",
       count(*) filter (where o_orderstatus = 'P') as "P"
from orders group by o_orderpriority
"""

SQL_BANDS = "('low', null, 100000), ('middle', 100000, 300000), ('high', 300000, null)"


def price_bands(spark: SparkSession, data_dir: str) -> DataFrame:
    """Orders counted in price bands, the outer two open."""
    bands = spark.sql(f"select band, double(low), double(high) from values {SQL_BANDS} as b(band, low, high)")
    priced = table(spark, data_dir, "orders").select("o_totalprice")
    met = band_join(priced, bands, "o_totalprice", "low", "high", 100_000.0)
    out = met.groupBy("band").agg(_count().alias("orders"), exact_sum(units("o_totalprice")).alias("total"))
    return out.select("band", "orders", as_double("total").alias("total"))


PRICE_BANDS_SQL = f"""
select band, count(*) as orders, {_money("sum(cast(o_totalprice as decimal(12,2)))")} as total
from orders
join (values {SQL_BANDS}) b(band, low, high)
  on (low is null or o_totalprice >= low) and (high is null or o_totalprice < high)
group by band
"""


def orders_of_one_year(spark: SparkSession, data_dir: str) -> DataFrame:
    """All orders written in a folder per year, and 1996 read back from its folder alone."""
    path = shared_dir(spark, "orders-by-year")
    orders = table(spark, data_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
    write_partitioned(orders, path, "order_year")
    back = read_partitions(spark, path, F.col("order_year") == 1996)
    return back.select("o_orderkey", "o_custkey", "o_totalprice", F.col("order_year").cast("long").alias("order_year"))


ORDERS_OF_ONE_YEAR_SQL = """
select o_orderkey, o_custkey, o_totalprice, year(o_orderdate) as order_year
from orders where year(o_orderdate) = 1996
"""


def frequent_name_words(spark: SparkSession, data_dir: str) -> DataFrame:
    """The three words found in the names of most parts of each brand."""
    words = (
        table(spark, data_dir, "part")
        .select("p_brand", F.explode(F.array_distinct(F.split(F.lower("p_name"), r"\s+"))).alias("word"))
        .groupBy("p_brand", "word")
        .agg(_count().alias("parts"))
    )
    top = top_per_group(words, ["p_brand"], [F.desc("parts"), F.asc("word")], 3)
    return top.withColumn("place", F.col("place").cast("long"))


FREQUENT_NAME_WORDS_SQL = """
select p_brand, word, parts, place from (
  select *, row_number() over (partition by p_brand order by parts desc, word) as place
  from (select p_brand, word, count(*) as parts
        from (select p_brand, unnest(list_distinct(string_split_regex(lower(p_name), '\\s+'))) as word from part)
        group by p_brand, word))
where place <= 3
"""


QUERIES = {
    "pricing_summary": Query(pricing_summary, PRICING_SUMMARY_SQL),
    "revenue_by_region": Query(revenue_by_region, REVENUE_BY_REGION_SQL),
    "top_customers": Query(top_customers, TOP_CUSTOMERS_SQL),
    "revenue_rollup": Query(revenue_rollup, REVENUE_ROLLUP_SQL),
    "flag_status_cube": Query(flag_status_cube, FLAG_STATUS_CUBE_SQL),
    "order_grouping_sets": Query(order_grouping_sets, ORDER_GROUPING_SETS_SQL),
    "largest_orders_per_customer": Query(largest_orders_per_customer, LARGEST_ORDERS_SQL),
    "order_history": Query(order_history, ORDER_HISTORY_SQL),
    "part_price_ranks": Query(part_price_ranks, PART_PRICE_RANKS_SQL),
    "big_spenders": Query(big_spenders, BIG_SPENDERS_SQL),
    "idle_customers": Query(idle_customers, IDLE_CUSTOMERS_SQL),
    "nation_parties": Query(nation_parties, NATION_PARTIES_SQL),
    "parts_in_both_years": Query(parts_in_both_years, PARTS_IN_BOTH_YEARS_SQL),
    "part_shipments_difference": Query(part_shipments_difference, PART_SHIPMENTS_DIFFERENCE_SQL),
    "customers_by_priority": Query(customers_by_priority, CUSTOMERS_BY_PRIORITY_SQL),
    "approx_customers_by_priority": Query(approx_customers_by_priority),
    "price_quantiles_by_priority": Query(price_quantiles_by_priority, PRICE_QUANTILES_SQL),
    "approx_price_quantiles_by_priority": Query(approx_price_quantiles_by_priority, APPROX_PRICE_QUANTILES_SQL),
    "status_pivot": Query(status_pivot, STATUS_PIVOT_SQL),
    "price_bands": Query(price_bands, PRICE_BANDS_SQL),
    "orders_of_one_year": Query(orders_of_one_year, ORDERS_OF_ONE_YEAR_SQL),
    "frequent_name_words": Query(frequent_name_words, FREQUENT_NAME_WORDS_SQL),
}
