"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.nearest import fit_index, nearest
from tidemark.plans.registry import Query
from tidemark.sources.tables import table


def asked(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % 50 == 0)


def nearest_vectors(spark: SparkSession, data_dir: str) -> DataFrame:
    """The five nearest of all vectors to every vector whose id is divisible by 50, exactly."""
    vectors = table(spark, data_dir, "embeddings")
    return nearest(vectors, asked(vectors))


NEAREST_VECTORS_SQL = """
with scored as (
  select q.vec_id as query_id, v.vec_id as neighbour_id,
         round(list_dot_product(q.embedding::double[], v.embedding::double[]), 6) as score
  from embeddings q, embeddings v where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id
)
select * from (
  select *, row_number() over (partition by query_id order by score desc, neighbour_id) as place from scored)
where place <= 5
"""


def nearest_vectors_by_index(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same by the cells of an inverted-file index; some neighbours may be missed."""
    vectors = table(spark, data_dir, "embeddings")
    return nearest(vectors, asked(vectors), index=fit_index(vectors))


QUERIES = {
    "nearest_vectors": Query(nearest_vectors, NEAREST_VECTORS_SQL),
    "nearest_vectors_by_index": Query(nearest_vectors_by_index),
}
