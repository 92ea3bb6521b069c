"""Rows of a group put together in order, in pieces of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import OrderedGroups


def joined_texts(
    df: DataFrame, keys: list[str], order: list[str], text: str, between: str = "\n", piece_rows: int = 10_000, **limits
) -> DataFrame:
    """(keys, piece, rows, text): the column ``text`` of each group, put together in ``order``.

    A group of up to ``piece_rows`` rows gives one row, piece 0. A longer one gives a row for every so
    many of its rows, by their places in the whole group, so that no task builds a text that grows
    with a group, and pieces joined again by ``between`` are the text. Places come from
    ``OrderedGroups``, which cuts long groups into runs; ``order`` names columns that tell a group's rows apart.

    A null text counts as empty; null keys are a group. ``limits`` go to ``OrderedGroups``.
    """
    rows = df.select(*keys, *order, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    placed = OrderedGroups(rows, keys, order, **limits).ranked().df()
    piece = F.floor((F.col("row_number") - 1) / piece_rows).alias("piece")
    parts = placed.groupBy(*keys, piece).agg(F.array_sort(F.collect_list(F.struct("row_number", "_text"))).alias("_parts"))
    return parts.select(*keys, "piece", F.size("_parts").cast("bigint").alias("rows"), F.array_join(F.transform("_parts", lambda p: p["_text"]), between).alias("text"))
