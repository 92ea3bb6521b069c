from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare


@dataclass(frozen=True)
class Query:
    """``build`` takes a session and a data folder; ``sql`` is the same query for a SQL engine."""

    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, data_dir: str) -> DataFrame:
        return self.build(prepare(spark), data_dir)
