"""Documents packed into sequences of bounded length by best-fit decreasing."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep, per_batch, texts
from tidemark.llm.vocabulary import Chunks, read_bytes, tiktoken_of

CAPACITY = 1024
END = 2
#: Pieces of one length that are numbered in one go.
RANKED = 250_000


class OpenBins:
    """A segment tree over remaining capacities: how many bins are open with each, and the
    tightest that still takes a given length, in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += bins
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that a bin has."""
        at = length + self.size
        while not self.tree[at]:
            while at & 1:  # from a right child the next leaves lie above
                at >>= 1
            if not at:
                return None
            at |= 1  # the sibling to the right
        while at < self.size:
            at <<= 1
            if not self.tree[at]:
                at |= 1
        return at - self.size


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over pieces of which only the lengths are known.

    Pieces of one length are alike, and so are bins with the same room, so each step places a
    run of them. Gives (length, first, pieces, per_bin, first_bin, offset): of the pieces of
    that length, those numbered from ``first`` go to bins from ``first_bin`` on, ``per_bin`` to
    each, from ``offset`` on. The result is that of placing the pieces one by one: the bin that
    has just taken a piece is the tightest again as long as another piece fits.
    """
    tree, runs, new, plan = OpenBins(capacity), {}, 0, []
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                bins = -(-left // (capacity // length))
                runs.setdefault(room, []).append((new, bins))
                tree.add(room, bins)
                new += bins
            first, bins = runs[room].pop()
            fit = room // length
            used = min(bins, -(-left // fit))
            if used < bins:
                runs[room].append((first + used, bins - used))
            tree.add(room, -used)
            placed = min(left, used * fit)
            plan.append((length, done, placed, fit, first, capacity - room))
            spare = used * fit - placed  # the last bin may take fewer
            for at, n, rest in ((first, used - bool(spare), room - fit * length), (first + used - 1, int(bool(spare)), room - (fit - spare) * length)):
                if n and rest:
                    runs.setdefault(rest, []).append((at, n))
                    tree.add(rest, n)
            done, left = done + placed, left - placed
    return plan


def pieces(
    df: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, capacity: int = CAPACITY,
    end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each text's ids and the end id, cut into
    pieces of ``capacity`` ids where there are more; the first piece takes what is over. With
    ``with_ids`` the ids come too."""
    shared = df.sparkSession.sparkContext.broadcast(read_bytes(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def make():
        encoding = tiktoken_of(shared.value, pattern)
        chunks = Chunks(lambda t: np.array(encoding.encode_ordinary(t), "<u4").tobytes())
        last = np.array([end], "<u4").tobytes()

        def work(batch: pa.RecordBatch) -> dict:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = chunks.ids(text) + last
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * s : 4 * e]
                    rows.append((doc, k, s, e - s, zlib.crc32(part)) + ((np.frombuffer(part, "<i4"),) if with_ids else ()))
            return {f.name: list(c) for f, c in zip(schema, zip(*rows, strict=True), strict=True)} if rows else {f.name: [] for f in schema}

        return work

    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return texts(df, id_col, text_col).mapInArrow(per_batch(make, schema), out)


def pack(parts: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """``parts`` (rows of ``pieces``) with sequence_id and offset: best-fit decreasing over all.

    The driver sees how many pieces there are of each length, at most ``capacity`` numbers,
    and makes the plan, whose size depends on ``capacity`` only; that is why it may be
    broadcast. Pieces of one length are numbered in bins of some ``ranked`` by a hash, so a
    length that many share is not one task's work, and each looks up its place. Where ``parts``
    has a column ``salt``, bins go by that, so that pieces that are alike in all else are split too.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        best_fit(counts, capacity) or [(0,) * 6], "length bigint, first bigint, pieces bigint, per_bin bigint, first_bin bigint, base bigint"
    )
    slots = max(1, -(-max(counts.values(), default=1) // ranked))
    salted = "salt" in parts.columns
    slotted = parts.withColumn("slot", F.pmod(F.xxhash64("salt") if salted else F.xxhash64("doc_id", "piece"), F.lit(slots)))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ahead = slotted.groupBy("length", "slot").agg(F.count("*").alias("n")).select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "slot").orderBy(*["salt"] * salted, "doc_id", "piece", "start", "ids_crc32")
    numbered = (
        slotted.withColumn("rank", F.row_number().over(inside) - 1)
        .join(ahead, ["length", "slot"])
        .withColumn("rank", F.col("rank") + F.col("ahead"))
        .drop("slot", "ahead")
    )
    here = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces"))
    step = F.col("rank") - F.col("first")
    return numbered.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & here).select(
        *[c for c in parts.columns if c != "salt"],
        (F.col("first_bin") + F.expr("(rank - first) div per_bin")).alias("sequence_id"),
        (F.col("base") + F.pmod(step, F.col("per_bin")) * F.col("length")).alias("offset"),
    )


def pack_documents(df: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """All rows of ``df``, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids, with ``with_ids``).

    Nulls: a null text counts as empty, which is one piece of the end id alone; a null doc_id
    stays null. Very long texts become many pieces. Repeated rows are packed as often as they
    come. An empty table gives no rows. Other columns of ``df`` are not read. Pieces are a
    table in the shared folder, so texts are tokenized once.
    """
    # a number for each row, fixed once it is written
    salted = pieces(df, capacity=capacity, **how).withColumn("salt", F.monotonically_increasing_id())
    return pack(keep(salted, "pieces"), capacity)
