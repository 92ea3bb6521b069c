"""Near copies by SimHash, found through keys from which one bit is deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, keep, per_batch, texts
from tidemark.llm.components import components

BITS = 3
SHINGLE = 3
SEED = 42
#: Members of a key's group that are compared in one go; larger groups are cut by a second key.
GROUP = 4096

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the text's 3-word shingles."""
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    grams = map(" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # a long text's bits are not all unpacked at once
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row, the 64 bits as a signed number. A null text counts as empty, a
    text without words gets 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            prints = np.fromiter((fingerprint(t) for t in batch["text"].to_pylist()), np.uint64, batch.num_rows)
            return {"doc_id": batch["doc_id"], "fp": prints.view(np.int64)}

        return work

    return texts(df, id_col, text_col).mapInArrow(per_batch(make, schema), "doc_id bigint, fp bigint")


def with_fingerprint(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a column ``fp``, all else as it is."""
    place, names, kind = df.columns.index(text_col), [*df.columns, "fp"], T.StructType([*df.schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                prints = np.fromiter((fingerprint(t or "") for t in part.column(place).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints.view(np.int64))], names=names)

    return df.mapInArrow(run, kind)


def blanked(part: Column, width: int, tag: int) -> Column:
    """The keys of a part of ``width`` bits, at most 32: for each place the part without that
    bit, under the tag and the place."""
    return F.array(*[part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << i))).bitwiseOR(F.lit((tag << 37) | (i << 32))) for i in range(width)])


def keyed(fps: DataFrame, name: str, parts: list[Column], width: int) -> DataFrame:
    """``fps`` once for each key of each of its two parts. Of three differing bits one part has
    one at most, so any two fingerprints that link share a key."""
    keys = F.concat(*[blanked(p.bitwiseAND(F.lit((1 << width) - 1)), width, k) for k, p in enumerate(parts)])
    return fps.withColumn(name, F.explode(keys)).repartition(*[c for c in (*fps.columns, name) if c != "fp"]).sortWithinPartitions(*[c for c in (*fps.columns, name) if c != "fp"])


def tied(fps: np.ndarray, bits: int) -> np.ndarray:
    """For each of some distinct fingerprints, the place of the first one that a chain of links
    leads to. What is reached is taken out, so a dense group takes few passes."""
    root = np.arange(len(fps))
    left = np.arange(len(fps))
    while len(left):
        first, left = left[0], left[1:]
        front = [first]
        while front and len(left):
            near = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= bits
            if near.any():
                found = left[near]
                root[found] = first
                front += found.tolist()
                left = left[~near]
    return root


def blank_place(key: int, width: int) -> int:
    """The place of the bit that ``key`` leaves out, counted over both parts; 0 of a part: -1."""
    place = (key >> 32) & 31
    return ((key >> 37) & 1) * width + place if place else -1


def link(names: list[str], most: int | None, bits: int):
    """A function for ``mapInArrow`` on (fp, keys ``names``), sorted by the keys.

    It gives (a, b, null) for a link between two fingerprints of a group, or (fp, null, key)
    for each row of a group of over ``most`` rows, to be cut by a second key. Under keys that
    leave out any place but a part's first, a group is of interest only if its rows differ
    there: rows that do not differ meet under the first place's key as well.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k1", pa.int64())])

    def differs(fps: np.ndarray, keys: list[int]) -> bool:
        places = [blank_place(keys[0], 32)]
        if len(keys) > 1:  # the second key cuts the part that the first one does not use
            inner = blank_place(keys[1], 16)
            places.append(inner if inner < 0 else inner + (0 if (keys[0] >> 37) & 1 else 32))
        some = np.bitwise_or.reduce(fps ^ fps[0])
        return all(p < 0 or (int(some) >> p) & 1 for p in places)

    def links(cols: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        a, b = [], []
        for s, e in zip(starts, ends, strict=True):
            fps = cols[0][s:e].view(np.uint64)
            if differs(fps, [int(c[s]) for c in cols[1:]]):
                root = tied(fps, bits)
                moved = np.flatnonzero(root != np.arange(e - s))
                a.append(cols[0][s:e][moved])
                b.append(cols[0][s:e][root[moved]])
        if not sum(map(len, a)):
            return None
        a = np.concatenate(a)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate(b)), pa.nulls(len(a), pa.int64())], schema=schema)

    def onward(fps: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(key)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * (1 + len(names))
        large = None  # the key of a group that is being handed on
        for batch in batches:
            cols = [np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ["fp", *names], strict=True)]
            if large is not None:
                same = int(np.argmin(np.r_[cols[1] == large, False]))
                if same:
                    yield onward(cols[0][:same], cols[1][:same])
                    cols = [c[same:] for c in cols]
                if not len(cols[0]):
                    held = cols
                    continue
                large = None
            change = np.zeros(len(cols[0]) - 1, bool)
            for c in cols[1:]:
                change |= c[1:] != c[:-1]
            starts = np.r_[0, np.flatnonzero(change) + 1]
            ends = np.r_[starts[1:], len(cols[0])]
            held = [c[starts[-1] :] for c in cols]
            if most and len(held[0]) > most:
                large = int(held[1][0])
                yield onward(held[0], held[1])
                held = [h[:0] for h in held]
            starts, ends = starts[:-1], ends[:-1]
            sizes = ends - starts
            if most:
                for k in np.flatnonzero(sizes > most):
                    yield onward(cols[0][starts[k] : ends[k]], cols[1][starts[k] : ends[k]])
            some = (sizes > 1) & (sizes <= (most or sizes.max(initial=0)))
            if (found := links(cols, starts[some], ends[some])) is not None:
                yield found
        if len(held[0]) > 1 and (found := links(held, np.array([0]), np.array([len(held[0])]))) is not None:
            yield found

    return run


def near_copies(df: DataFrame, bits: int = BITS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, fp (its 64-bit fingerprint), component_id (the
    smallest doc_id that links lead to, its own included), root (one fingerprint of the component,
    which tells components apart also where they share an id).

    Fingerprints link at ``bits`` or fewer differing bits, 3 at most. Equal fingerprints count
    once. Each is cut into two parts, of which one differs by one bit at most; its keys are
    the parts with one bit left out. Rows that share a key are compared, and only what ties
    them together goes on, not all pairs. A key that over ``group`` fingerprints share is cut
    again the same way over the part it does not use, which leaves 18 free bits, so no group
    has over 2^18 members.

    Nulls: a null text is empty, and a text without words has fingerprint 0, which links like
    any other. A null doc_id never becomes a component_id unless all of the component are
    null. Repeated rows come out as often as they come in. An empty table gives no rows. Other
    columns of ``df`` are not read.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two parts find 3 differing bits at most")
    prints = keep(fingerprints(df, id_col, text_col), "fingerprints")
    once = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    fp = F.col("fp")
    first = keyed(once.select("fp"), "k1", [fp, F.shiftrightunsigned("fp", 32)], 32)
    found = keep(first.mapInArrow(link(["k1"], group, bits), "a bigint, b bigint, k1 bigint"), "links")
    other = F.when(F.shiftright("k1", 37).bitwiseAND(F.lit(1)) == 1, fp).otherwise(F.shiftrightunsigned("fp", 32))
    again = keyed(found.where("k1 is not null").select(F.col("a").alias("fp"), "k1"), "k2", [other, F.shiftrightunsigned(other, 16)], 16)
    more = again.mapInArrow(link(["k1", "k2"], None, bits), "a bigint, b bigint, k1 bigint")
    roots = components(found.where("k1 is null").select("a", "b").unionByName(more.select("a", "b")))
    rooted = once.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "fp", "component_id", "root")


def brute_force(rows: list[tuple[int, str | None]], bits: int = BITS) -> list[tuple[int, str, int]]:
    """The same on a list, comparing all pairs; for tests."""
    prints = [fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, f"{p:016x}", least[find(i)]) for i, ((doc, _), p) in enumerate(zip(rows, prints, strict=True))]
