"""Which keys of one chunk of documents occur in another chunk, without moving rows per key.

Documents are dealt into chunks of a few megabytes by a hash. Each chunk sends every key it
has once, however often it occurs there, as sorted 64-bit numbers packed by bucket: eight
bytes a key, and a passage that a third of all documents hold costs one entry a chunk. A
bucket's keys are sorted and neighbours compared. What goes back to each chunk is a bit per
key it sent. Chunks and buckets are bounded and their number grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 4 << 20
#: Chunks and buckets get a task each up to so many tasks, beyond that a few share one.
MOST_TASKS = 1 << 16


def dealt(df: DataFrame, by: str, groups: int) -> DataFrame:
    """``df`` gathered by the column ``by``, which has ``groups`` values: the number of tasks
    grows with the input, whatever the session's number of shuffle partitions."""
    return df.repartition(min(groups, MOST_TASKS), by)


def chunked(df: DataFrame, bytes_a_chunk: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``df`` (with doc_id and text) with a column ``chunk``, gathered by it, and its total bytes."""
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / bytes_a_chunk))
    at = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int")
    return dealt(df.withColumn("chunk", at), "chunk", chunks), total


def buckets_for(keys: int) -> int:
    return max(1, math.ceil(keys / BUCKET_KEYS))


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted ``keys``: buckets are equal ranges of 64-bit numbers."""
    bounds = [(b << 64) // buckets for b in range(1, buckets)]
    return np.r_[0, np.searchsorted(keys, np.array(bounds, np.uint64)), len(keys)]


def seen_elsewhere(
    chunks: DataFrame, keys_of: Callable[..., np.ndarray], buckets: int, marks: DataFrame | None = None
) -> DataFrame:
    """(chunk, bucket, marks): bits for the sorted distinct keys of the chunk in the bucket,
    set where another chunk has the key.

    ``keys_of`` takes a chunk's rows (and, with ``marks``, an earlier round's bits for them)
    and returns the chunk's sorted distinct keys.
    """

    def packed(table: pa.Table, keys: np.ndarray) -> pa.Table:
        edges = bucket_edges(keys, buckets)
        full = np.flatnonzero(np.diff(edges))
        chunk = table["chunk"][0].as_py() if len(full) else None
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "chunk": pa.array([chunk] * len(full), pa.int32()),
                "keys": pa.array([keys[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
            }
        )

    def send(table: pa.Table) -> pa.Table:
        return packed(table, keys_of(table))

    def send_again(table: pa.Table, earlier: pa.Table) -> pa.Table:
        return packed(table, keys_of(table, earlier) if table.num_rows else np.zeros(0, np.uint64))

    def compare(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(every), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        ends = np.cumsum([len(p) for p in parts])
        bits = [np.packbits(x).tobytes() for x in np.split(twice, ends[:-1])]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "marks": pa.array(bits, pa.binary())})

    sent_type = "bucket int, chunk int, keys binary"
    groups = chunks.groupBy("chunk")
    if marks is None:
        sent = groups.applyInArrow(send, sent_type)
    else:
        sent = groups.cogroup(marks.groupBy("chunk")).applyInArrow(send_again, sent_type)
    return dealt(sent, "bucket", buckets).groupBy("bucket").applyInArrow(compare, "chunk int, bucket int, marks binary")


def marked(keys: np.ndarray, buckets: int, marks: pa.Table) -> np.ndarray:
    """For a chunk's sorted distinct ``keys``: whether another chunk has each."""
    edges = bucket_edges(keys, buckets)
    out = np.zeros(len(keys), bool)
    for b, bits in zip(marks["bucket"].to_pylist(), marks["marks"].to_pylist(), strict=True):
        n = edges[b + 1] - edges[b]
        out[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out
