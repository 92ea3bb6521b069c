"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) but the roots; root is the component's smallest node.

    Each round has two steps. Every node ties its larger neighbours to the smallest node next
    to it, then ties itself and its smaller neighbours to that one. Edges stay as many or get
    fewer, and after some log(n) rounds each component is a star around its smallest node. Sums are
    worked out before the shuffle and joins are left to Spark, which splits skewed keys.
    Each round's edges are a table in the shared folder.
    """

    def step(both: DataFrame, larger: bool) -> DataFrame:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        tied = both.join(least, "a")
        tied = tied.where("b > a") if larger else tied.where("b <= a")
        return tied.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()

    def around(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def down(e: DataFrame) -> DataFrame:
        """Each edge from its larger end, and that end tied to itself, so that it moves too."""
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return e.unionByName(e.select("a", F.col("a").alias("b")))

    now = keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = keep(step(down(step(around(now), larger=True)), larger=False), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
    raise RuntimeError(f"components are not stable after {most_rounds} rounds")
