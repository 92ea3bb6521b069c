"""A corpus made ready for training: toxic texts out, one of each group of near copies, passages
that texts share out, secrets masked, and what is left packed into sequences.

Each stage works on all that the one before it kept. All but the last return the columns of
``documents``, whatever else the table holds. Rows without a doc_id cannot be named by a group
and stay. Rows that share a doc_id are told apart by their texts, so each group keeps one row and no
text is lost that has no copy. A null text stays null until passages are taken out, and counts as
empty from there on. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import prepare
from tidemark.llm import packing, secrets, simhash, substring_dedup, toxicity
from tidemark.llm.common import documents, keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row of least id stays, of equal ones the least by text."""
    docs, others = docs.select(*COLUMNS), COLUMNS[1:]
    groups = keep(simhash.near_copies(docs).where("doc_id is not null"), "near-copies")
    chosen = groups.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("one")).select("one.doc_id", "one.fp")
    # an id that texts with different fingerprints share does not say which of them stays
    shared = groups.groupBy("doc_id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("doc_id")
    plain = docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").join(shared, "doc_id", "left_anti")
    told = simhash.with_fingerprint(docs.join(shared, "doc_id", "left_semi")).join(chosen, ["doc_id", "fp"], "left_semi")
    rows = plain.withColumn("fp", F.lit(None).cast("bigint")).unionByName(told)
    one = rows.groupBy("doc_id", "fp").agg(F.min(F.struct(*others)).alias("row"))
    return one.select("doc_id", *[f"row.{c}" for c in others]).unionByName(docs.where("doc_id is null"))


def shared_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur elsewhere too go; the document stays with what is left."""
    left = substring_dedup.remove_repeats(docs, layout=True, carry=("lang", "source"))
    return left.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source", F.length("kept").cast("bigint").alias("n_chars"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_copies_stage),
    ("substring dedup", shared_passages_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL expresses the compressor, XXH64 or the tokenizer; tests hold the result against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepare(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
