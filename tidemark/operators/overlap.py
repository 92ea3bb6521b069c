"""What a large table of texts shares with a small one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shingles import WORD, window_hashes, word_hashes

#: A Bloom filter of the small side has this many bits a shingle and sets so many; it is
#: made only if that side has at most ``MOST_SHINGLES``, which makes it 8 MB at most.
BITS_EACH, PROBES, MOST_SHINGLES = 16, 6, 1 << 22


def places(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    step = (hashes >> np.uint64(17)) | np.uint64(1)
    return np.stack([((hashes + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(probes)])


def shingled(df: DataFrame, id_col: str, text_col: str, width: int, filter_of: tuple[bytes, int] | None = None) -> DataFrame:
    """(id, shingle) for every window of ``width`` words of each text, as the words joined by one space;
    with a filter, only for windows that are in it."""
    schema = pa.schema([("id", pa.int64()), ("shingle", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if filter_of:
            data, bits = filter_of
            packed = np.frombuffer(data, np.uint8)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, out = [], []
                part = batch.slice(lo, 256)
                for doc, text in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    words = WORD.findall(text)
                    starts = np.arange(max(0, len(words) - width + 1))
                    if filter_of and len(starts):
                        at = places(window_hashes(word_hashes(words), width), bits, PROBES)
                        starts = np.flatnonzero(((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))
                    found = {" ".join(words[s : s + width]) for s in starts.tolist()}
                    ids += [doc] * len(found)
                    out += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], schema=schema)

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id bigint, shingle string")


def bloom(shingles: DataFrame, n: int) -> tuple[bytes, int]:
    """A Bloom filter of ``n`` shingles, made from their hashes in each task and put together."""
    bits = 1 << max(10, (n * BITS_EACH - 1).bit_length())
    kind = pa.schema([("word", pa.int64()), ("mask", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [window_hashes(word_hashes(s.split(" ")), s.count(" ") + 1) for s in batch["shingle"].to_pylist()]
            at = np.unique(places(np.concatenate(hashes), bits, PROBES)) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], schema=kind)

    words = shingles.select("shingle").mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    full = np.zeros(bits // 64, np.uint64)
    full[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return np.packbits(np.unpackbits(full.view(np.uint8), bitorder="little")).tobytes(), bits


def shared_shingles(
    df: DataFrame,
    small: DataFrame,
    width: int = 8,
    most_shingles: int = MOST_SHINGLES,
    id_col: str = "doc_id",
    text_col: str = "text",
    small_id: str = "item_id",
    small_text: str = "text",
) -> DataFrame:
    """(id, small_id, shared) for each text of ``df`` and of ``small`` that share a window of ``width``
    words: how many different ones.

    The small side's windows are counted; up to ``most_shingles`` of them go into a Bloom filter
    of a known size, by which the large side's windows are sifted where they are read, so that
    hardly any is shuffled that meets nothing. With more, all windows are shuffled. Either way the
    join is by the words themselves, and a window that many texts hold is split by Spark's skewed joins.

    Nulls: a null text has no windows; a null id stays null and counts as one id. Texts of fewer words have none.
    Empty tables give no rows. Other columns are not read.
    """
    mine = shingled(small, small_id, small_text, width).withColumnRenamed("id", "small_id").distinct()
    n = mine.count()
    sifted = shingled(df, id_col, text_col, width, bloom(mine, n) if 0 < n <= most_shingles else None)
    # rows that share an id count a window once
    return sifted.distinct().join(mine, "shingle").groupBy("id", "small_id").agg(F.count("*").alias("shared")) if n else sifted.limit(0).select("id", F.lit(None).cast("bigint").alias("small_id"), F.lit(0).cast("bigint").alias("shared"))
