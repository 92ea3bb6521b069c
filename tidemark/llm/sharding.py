"""Shards of nearly equal bytes by histogram sort: splitters are refined by counting, then rows move once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep

SHARDS = 16
#: A splitter is good enough if it is off by this share of a shard's bytes.
TOLERANCE = 0.001
PROBES = 256
TOP = 1 << 63
#: Rows that are numbered in one go.
NUMBERED = 32_768


def key_of(*columns: str) -> Column:
    """A hash of ``columns`` as a number from 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def salted(key: Column) -> Column:
    """``key`` with its last 16 bits from a number of the row, which is fixed once the table is written."""
    row = F.xxhash64(F.monotonically_increasing_id())
    return key.bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(row.bitwiseAND(F.lit(0xFFFF)))


@dataclass(frozen=True)
class Search:
    """Where a splitter is still looked for: among keys from ``low`` to before ``high``, of
    ``hi``, or of ``lo`` where all these rows have ``hi`` equal to ``within``."""

    within: int | None
    low: int
    high: int
    below: int

    def column(self) -> str:
        return "hi" if self.within is None else "lo"

    def step(self, probes: int) -> int:
        return max(1, -(-(self.high - self.low) // probes))

    def condition(self) -> Column:
        k = F.col(self.column())
        inside = (k >= F.lit(self.low)) & (k <= F.lit(self.high - 1))
        return inside if self.within is None else inside & (F.col("hi") == F.lit(self.within))

    def point(self, key: int) -> tuple[int, int]:
        return (key, 0) if self.within is None else (self.within, key)


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[tuple[int, int]]:
    """The ``shards`` - 1 keys (hi, lo) at which shards begin, for ``rows`` of hi, lo and size.

    Each round counts, in one pass and exactly, the bytes between ``probes`` candidate keys
    for every splitter that is not settled, and looks on between the two that enclose the
    bytes it wants. A key that many rows share is split by ``lo``. Rows with equal hi and lo
    stay together. The driver sees some ``shards`` times ``probes`` sums a round.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = {j: total * j / shards for j in range(1, shards)}
    allowed = tolerance * total / shards
    done: dict[int, tuple[int, int]] = {}
    looking = dict.fromkeys(wanted, Search(None, 0, TOP, 0)) if total else {}
    while looking:
        places = list(dict.fromkeys(looking.values()))
        which, part, key = F.lit(None).cast("int"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
        for i, s in enumerate(places):
            k = F.col(s.column())
            which = F.when(s.condition(), F.lit(i)).otherwise(which)
            part = F.when(s.condition(), F.floor((k - F.lit(s.low)) / F.lit(1)) if s.step(probes) == 1 else F.expr(f"({s.column()} - {s.low}L) div {s.step(probes)}L")).otherwise(part)
            key = F.when(s.condition(), k).otherwise(key)
        sums = (
            rows.select(which.alias("i"), part.alias("part"), key.alias("key"), "size").where("i is not null").groupBy("i", "part")
            .agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
        )
        by: dict[int, list] = {}
        for r in sorted(sums, key=lambda r: r["part"]):
            by.setdefault(r["i"], []).append(r)
        for j, s in list(looking.items()):
            below = s.below
            for r in by[places.index(s)]:
                if below + r["size"] >= wanted[j]:
                    break
                below += r["size"]
            after = below + r["size"]
            near = min((wanted[j] - below, s.point(r["least"])), (after - wanted[j], s.point(r["most"] + 1)))
            if near[0] <= allowed or r["n"] == 1 or (s.within is not None and r["least"] == r["most"]):
                done[j] = near[1]
                del looking[j]
            elif r["least"] == r["most"]:
                looking[j] = Search(r["least"], 0, TOP, below)
            else:
                looking[j] = Search(s.within, r["least"], r["most"] + 1, below)
    return sorted(done.values())


def shard(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, numbered: int = NUMBERED) -> DataFrame:
    """``rows`` (hi, lo, size and any other columns) with shard and slot, by law ``bytes``: the
    shards' sizes are near equal. Rows move once, to be numbered.

    Slots count from 0 without gaps in each shard. Rows of a shard are numbered in bins of some
    ``numbered`` by ``lo``, after the rows of the bins before.
    """
    points = splitters(rows, shards, tolerance)
    at = F.lit(0)
    for hi, lo in points:
        # a key one past the largest is past all rows
        at = at + (F.lit(False) if hi >= TOP else (F.col("hi") > F.lit(hi)) | ((F.col("hi") == F.lit(hi)) & (F.col("lo") >= F.lit(min(lo, TOP - 1))))).cast("int")
    count = rows.count()
    bins = max(1, -(-count // (shards * numbered)))
    placed = rows.withColumn("shard", at).withColumn("bin", F.pmod(F.col("lo"), F.lit(bins)))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy("shard", "bin").agg(F.count("*").alias("n")).select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", "bin").orderBy("hi", "lo", *[c for c in rows.columns if c not in ("hi", "lo")])
    numbers = placed.withColumn("slot", F.row_number().over(inside) - 1)
    return numbers.join(ahead, ["shard", "bin"]).select(*rows.columns, "shard", (F.col("slot") + F.col("ahead")).alias("slot"))


def shard_documents(df: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of ``df``; size is the text's UTF-8 bytes
    and 1.

    Rows are sorted by a hash of the text and then of the id, so equal texts stand side by
    side and share a shard unless a boundary falls among them, as it must where a third of
    all rows are one text. What is sorted is a table of numbers in the shared folder, from
    which every round counts.

    Nulls: a null text has no bytes and so size 1; a null id is one more id. A text larger
    than a shard's share fills its shard. Rows with equal id and text are told apart by a
    number that is fixed in the written table, so a boundary may fall among them too. An empty
    table gives no rows. Other columns of ``df`` are not read.
    """
    doc, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = df.select(doc.alias("doc_id"), text.alias("text")).select(
        "doc_id", (F.octet_length("text") + 1).cast("bigint").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        key_of("text").alias("hi"), salted(key_of("doc_id", "text")).alias("lo"),
    )
    return shard(keep(slim, "shard-keys"), shards, tolerance).select("doc_id", "size", "text_crc32", "shard", "slot")
