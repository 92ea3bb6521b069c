"""Texts that are near copies by the Jaccard similarity of their word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shingles import mixed, shingles
from tidemark.operators.components import components
from tidemark.operators.ordered import written

WIDTH, SIMILARITY = 5, 0.8
#: A signature has ``BANDS`` bands of ``ROWS`` least hashes. Two texts with similarity s agree in
#: some band with a chance of 1 - (1 - s^ROWS)^BANDS: all but 5 in 10^8 at 0.8.
BANDS, ROWS = 32, 4
#: 64-bit words of the bitmap that stands for a set where pairs are met; its bits are a power of two.
WORDS = 32


def signature(shingle: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of least hashes. A text without shingles has none.

    Shingles are well mixed numbers, so an odd factor and a term make a further hash of each. That is
    two operations a hash and shingle, worked through in stretches that stay in the cache.
    """
    if not len(shingle):
        return np.zeros(0, np.int64)
    fixed = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1, 1)
    factors, terms = fixed[0] | np.uint64(1), fixed[1]
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingle), 128):
        hashes = factors * shingle[lo : lo + 128]
        hashes += terms
        np.minimum(least, hashes.min(axis=1), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def in_slices(work: Callable[[list[str]], dict], kind: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` on (doc_id, text): ``work`` gives the other columns for some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], **work(part["text"].to_pylist())}, schema=kind)

    return run


def digest(shingle_set: np.ndarray) -> str:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).hexdigest()


def set_of(text: str, width: int) -> np.ndarray:
    """The text's shingles. Bytes are split at the same six characters as ``WORD``, faster, and hash as their text does."""
    return shingles(text.lower().encode().split(), width)


def signed(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, same, n, bands): a digest of the set of shingles, their number, and its bands."""
    kind = pa.schema([("doc_id", pa.int64()), ("same", pa.string()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def work(some: list[str]) -> dict:
        sets = [set_of(t, width) for t in some]
        return {"same": [digest(s) for s in sets], "n": list(map(len, sets)), "bands": [signature(s, bands, rows) for s in sets]}

    return texts.mapInArrow(in_slices(work, kind), "doc_id bigint, same string, n int, bands array<bigint>")


def bitmap(shingle_set: np.ndarray) -> np.ndarray:
    """A bit for each shingle, at a place of its own hash's leading bits, in ``WORDS`` numbers."""
    marks = np.zeros(64 * WORDS, np.uint8)
    marks[shingle_set >> np.uint64(64 - (64 * WORDS - 1).bit_length())] = 1
    return np.packbits(marks).view(np.int64)


def with_sets(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, same, shingle_set, bits)."""
    numbers = pa.list_(pa.int64())
    kind = pa.schema([("doc_id", pa.int64()), ("same", pa.string()), ("shingle_set", numbers), ("bits", numbers)])

    def work(some: list[str]) -> dict:
        sets = [set_of(t, width) for t in some]
        return {"same": [digest(s) for s in sets], "shingle_set": [s.view(np.int64) for s in sets], "bits": [bitmap(s) for s in sets]}

    return texts.mapInArrow(in_slices(work, kind), "doc_id bigint, same string, shingle_set array<bigint>, bits array<bigint>")


def alike(a: str, b: str, similarity: float) -> Column:
    """shared >= similarity * (all - shared), in a form that works ``shared`` out once."""
    shared = F.size(F.array_intersect(a, b))
    return shared * F.lit(1 + similarity) >= F.lit(similarity) * (F.size(a) + F.size(b)) - F.lit(1e-9)


def crossing(placed: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``placed`` (id, band, root, pivot_root) that share a band, are in different components
    and may be alike. One of them is outside its band's pivot's component.

    Two sets that are alike differ in (1 - similarity) / (1 + similarity) of their shingles, counted in both, or less.
    Each bit in which their bitmaps differ is a shingle that only one has. So no pair that is alike
    is left out, and of a large group of texts that are less alike few pairs are made. Bits are compared
    inside the join by band: what it reads grows with the members, and pairs that it drops are never written.
    """
    words = [F.coalesce(F.get("bits", i), F.lit(0)) for i in range(WORDS)]
    told = placed.join(whole.select("id", F.size("shingle_set").alias("n"), "bits"), "id")

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        named = [F.col(c).alias(f"{name}_{c}") for c in ("root", "n")]
        return rows.select("band", F.col("id").alias(name), *named, *more, *[w.alias(f"{name}_{i}") for i, w in enumerate(words)])

    outside = side(told.where("root <> pivot_root"), "a")
    every = side(told.withColumn("inside", F.col("root") == F.col("pivot_root")), "b", "inside")
    near_size = F.least("a_n", "b_n") >= F.lit(similarity) * F.greatest("a_n", "b_n") - F.lit(1e-9)
    differ = reduce(add, [F.bit_count(F.col(f"a_{i}").bitwiseXOR(F.col(f"b_{i}"))) for i in range(WORDS)])
    near_bits = differ * F.lit(1 + similarity) <= F.lit(1 - similarity) * (F.col("a_n") + F.col("b_n")) + F.lit(1e-6)
    return outside.join(every, "band").where("a_root <> b_root and (inside or a < b)").where(near_size & near_bits).select("a", "b")


def near_copies(
    df: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, representative, class_id) per row of ``df``: the least id with the same set of shingles, and
    the least id that is reached over links. Two texts are linked if the Jaccard similarity of
    their sets of ``width``-word shingles, in lower case, is ``similarity`` or more.

    Texts with one set are one representative from the start, so copies meet nobody. What shares
    a band with others is first compared with the least id of that band, one pair a member; then,
    where a band's members fall into several components, members outside that of the least id
    with all members of other components. Pairs inside a component are never made: they could add nothing. So
    every link between different components is found that the bands let meet, and a large
    group of near copies costs a pair a member. Members that meet outside are first compared by bitmaps, which
    lose no link (see ``crossing``). Sets are compared whole, by 64-bit hashes.

    Nulls: a null id is a class of its own text's least id, or null. A text of fewer words than
    ``width`` has one shingle; one without words, or null, has none and is only a copy of others
    like it. An empty table gives no rows. Other columns of ``df`` are not read.
    """
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = written(signed(texts, width, bands, rows))
    firsts = marks.groupBy("same").agg(F.min("doc_id").alias("representative"))
    members = marks.select("doc_id", "same").join(firsts, "same").select("doc_id", "representative")
    once = marks.where("doc_id is not null and n > 0").groupBy("same").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    distinct = written(once)
    # an id that several texts share stands for all of them
    banded = distinct.select("id", F.explode("bands").alias("band"))
    met = banded.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").drop("last")
    shared = written(banded.join(met, "band"))

    # whole sets are only made of texts that share a band with others
    some = texts.join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    told = with_sets(some, width).join(distinct.select(F.col("id").alias("doc_id"), "same"), ["doc_id", "same"])
    whole = written(told.groupBy(F.col("doc_id").alias("id"), "same").agg(F.any_value("shingle_set").alias("shingle_set"), F.any_value("bits").alias("bits")))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are alike."""
        own = [whole.select(F.col("id").alias(c), F.col("shingle_set").alias(f"{c}_set")) for c in "ab"]
        return written(pairs.where("a <> b").distinct().join(own[0], "a").join(own[1], "b").where(alike("a_set", "b_set", similarity)).select("a", "b").distinct())

    to_pivot = linked(shared.select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    found = components(to_pivot)

    def rooted(side: DataFrame, of: str, name: str) -> DataFrame:
        return side.join(found.select(F.col("node").alias(of), F.col("root").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))

    placed = written(rooted(rooted(shared, "id", "root"), "pivot", "pivot_root"))
    final = components(to_pivot.unionByName(linked(crossing(placed, whole, similarity))))
    return members.join(final.withColumnRenamed("node", "representative"), "representative", "left").select(
        "doc_id", "representative", F.coalesce("root", "representative").alias("class_id")
    )
