"""Byte-level BPE: ids of texts, and texts of ids, by a public vocabulary."""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import packed, per_batch, texts
from tidemark.llm.vocabulary import Chunks, ranks_of, read_bytes

MASK = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash: n keys to n slots, found by hash and displacement.

    Keys are dealt into buckets. From the largest bucket on, each takes the first displacement
    that puts all its keys into free slots; buckets of one key then take what slots are left,
    by name.
    """

    def __init__(self, keys: list[bytes]):
        n, self.buckets = len(keys), max(1, len(keys) // 2)
        self.slots = n
        members: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for k in keys:
            h = xxhash.xxh64_intdigest(k)
            members[(h >> 32) % self.buckets].append((h, k))
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                break
            d = 0
            while True:
                at = [self.spot(h, d) for h, _ in members[b]]
                if len(set(at)) == len(at) and all(self.keys[s] is None for s in at):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, k) in zip(at, members[b], strict=True):
                self.keys[s] = k
        free = (s for s in range(n) if self.keys[s] is None)
        for b in range(self.buckets):
            if len(members[b]) == 1:
                s = next(free)
                self.shift[b], self.keys[s] = -1 - s, members[b][0][1]

    def spot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15 & MASK)) * 0xD6E8FEB86659FD93) & MASK
        return (x >> 31) % self.slots

    def slot(self, key: bytes) -> int:
        """The slot of ``key``, or -1 if it is no key."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[(h >> 32) % self.buckets]
        s = -1 - d if d < 0 else self.spot(h, d)
        return s if self.keys[s] == key else -1


class Vocabulary:
    """What encoding needs: the perfect hash over whole tokens, their ids by slot, and the id
    that each pair of ids merges into."""

    def __init__(self, content: bytes):
        ranks = ranks_of(content)
        self.hash = PerfectHash(list(ranks))
        self.ids = [ranks[k] for k in self.hash.keys]
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.tokens = {r: t for t, r in ranks.items()}
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def merged(self, raw: bytes) -> list[int]:
        """Ids of a pre-token that is no token: its bytes are a linked list, and a heap gives
        the pair of lowest rank, the leftmost first."""
        n, pairs = len(raw), self.pairs
        ids = list(map(self.bytes.__getitem__, raw))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [pairs.get(a << 32 | b, -1) for a, b in zip(ids, ids[1:], strict=False)]  # the rank of each part's merge with the next
        waiting.append(-1)
        heap = [rank * n + i for i, rank in enumerate(waiting) if rank >= 0]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            if waiting[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], waiting[i], waiting[j] = rank, -1, -1
            if k < n:
                before[k] = i
                new = waiting[i] = pairs.get(rank << 32 | ids[k], -1)
                if new >= 0:
                    heappush(heap, new * n + i)
            p = before[i]
            if p >= 0:
                new = waiting[p] = pairs.get(ids[p] << 32 | rank, -1)
                if new >= 0:
                    heappush(heap, new * n + p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def pretoken(self, raw: bytes) -> list[int]:
        slot = self.hash.slot(raw)
        return [self.ids[slot]] if slot >= 0 else self.merged(raw)


class Pretokens(dict):
    """The packed ids of pre-tokens, each worked out once but for long ones; emptied when
    it has ``most`` entries."""

    def __init__(self, vocab: Vocabulary, most: int = 450_000):
        super().__init__()
        self.vocab, self.most = vocab, most

    def __missing__(self, match: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        ids = self.vocab.pretoken(match.encode())
        packed_ids = struct.pack(f"<{len(ids)}i", *ids)
        if len(match) <= Chunks.LONG:
            self[match] = packed_ids
        return packed_ids


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(
    df: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, ids array<int>) per row of ``df``: the text's byte-level BPE ids.

    Each match of ``pattern`` is encoded by itself. A minimal perfect hash resolves matches
    that are tokens; others are merged by a heap over linked bytes. The tables are made once
    by the driver and broadcast; they are as large as the vocabulary.

    Nulls: a null text counts as empty, and an empty text has no ids. A null doc_id stays
    null. Long texts are worked through whole. Repeated rows come out as often as they come
    in, an empty table gives no rows, and other columns of ``df`` are not read.
    """
    shared = packed(df.sparkSession, Vocabulary(read_bytes(vocabulary or default_vocabulary())))
    ids_type = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", ids_type)])

    def make():
        vocab, find = pickle.loads(shared.value), regex.compile(pattern).findall
        pretokens = Pretokens(vocab)
        # chunks that differ in signs alone share pre-tokens
        chunks = Chunks(lambda text: b"".join(map(pretokens.__getitem__, find(text))), most=450_000)

        def work(batch: pa.RecordBatch) -> dict:
            parts = [chunks.ids(t) for t in batch["text"].to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
            flat = np.frombuffer(b"".join(parts), "<i4")
            return {"doc_id": batch["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}

        return work

    return texts(df, id_col, text_col).mapInArrow(per_batch(make, schema), "doc_id bigint, ids array<int>")


#: Ids that are decoded in one go, unless one text has more.
DECODED = 1 << 20


def runs_of(counts: list[int]) -> Iterator[tuple[int, int]]:
    """(start, rows) for neighbouring rows with ``DECODED`` ids or fewer together, or for one row."""
    start = n = 0
    for row, count in enumerate(counts):
        if row > start and n + count > DECODED:
            yield start, row - start
            start, n = row, 0
        n += count
    if len(counts) > start:
        yield start, len(counts) - start


def decode(df: DataFrame, vocabulary: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded``, the bytes that its ids stand for; null ids give null.

    The tokens are one array of bytes, from which those of many texts are taken at once; they
    then lie one after the other, so a text's bytes are what stands between two offsets. An
    empty list gives no bytes; an id outside the vocabulary, or null, fails the job.
    """
    ranks = ranks_of(read_bytes(vocabulary or default_vocabulary()))
    by_id = {r: t for t, r in ranks.items()}
    shared = packed(df.sparkSession, [by_id.get(r) for r in range(max(by_id) + 1)])
    place, names = df.columns.index(ids_col), [*df.columns, "decoded"]
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])

    def joined(lists: pa.ListArray, tokens: pa.Array) -> pa.Array:
        taken = tokens.take(lists.flatten())
        if taken.null_count:
            raise ValueError("an id that the vocabulary does not have")
        _, offsets, content = taken.buffers()
        at = np.frombuffer(offsets, np.int32)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
        raw = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at[ends].tobytes()), content])
        return pc.if_else(lists.is_valid(), raw, None) if lists.null_count else raw

    def run(batches):
        tokens = pa.array(pickle.loads(shared.value), pa.binary())
        for batch in batches:
            for start, rows in runs_of(pc.fill_null(pc.list_value_length(batch.column(place)), 0).to_pylist()):
                part = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, joined(part.column(place), tokens)], names=names)

    return df.mapInArrow(run, schema)
