"""Lines that many documents hold, found with two Bloom filters before any line moves."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange
from tidemark.llm.common import texts

#: Code points a line's key has at least, and documents that hold it at least, to be dropped.
LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
SPACES = " \t\n\x0b\x0c\r"
#: A filter is cut into segments of so many bits, planned for so many hashes; each hash sets
#: ``PROBES`` bits of its segment. The number of segments grows with the input.
SEGMENT_BITS, SEGMENT_HASHES, PROBES = 1 << 24, 1 << 20, 4


def key_of(line: str, least_chars: int) -> bytes | None:
    """The line stripped of white space and with A-Z in lower case, or None if it is too short."""
    bare = line.strip(SPACES)
    return bare.encode().lower() if len(bare) >= least_chars else None


class TwiceSeen:
    """Two Bloom filters: of hashes seen, and of those seen again. Every hash that was added
    twice is in the second; few others are. Memory is two arrays of ``bits``, whatever is added."""

    def __init__(self, bits: int = SEGMENT_BITS, probes: int = PROBES):
        self.mask, self.probes = np.uint64(bits - 1), probes
        self.once, self.twice = np.zeros(bits, bool), np.zeros(bits, bool)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33) | np.uint64(1)
        return np.stack([(hashes + np.uint64(j) * step) & self.mask for j in range(self.probes)])

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        """Distinct ``hashes``; where ``again`` is true, one that was added twice just now."""
        at = self.places(hashes)
        seen = self.once[at].all(axis=0) | again
        self.twice[at[:, seen]] = True
        self.once[at] = True

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        return self.twice[self.places(hashes)].all(axis=0)


def drop_common_lines(
    df: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
    segment_bits: int = SEGMENT_BITS,
    segment_hashes: int = SEGMENT_HASHES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_lines (before dropping), n_dropped and kept (the lines
    that stay, joined by \\n).

    A line's key is the line without white space at its ends and with A-Z in lower case. Lines
    whose key has ``least_chars`` code points and is found in ``least_documents`` rows go, except
    in the rows of the largest id that holds it, which keep all of theirs.

    Documents are dealt into chunks of a few megabytes. A chunk sends each segment of the filters
    the distinct hashes of its lines, once however often they occur, and gets back a bit for each:
    whether it is in the filter of what was seen twice. Only lines that are, one row a chunk and
    key, are sent on as text and counted exactly by it. So a line that only looks repeated costs
    a row and changes nothing, and one that a third of all documents hold costs a row a chunk.

    Nulls: a null text is one empty line; a null id counts as less than every id. Each row counts
    as a document, also where ids repeat. Very long texts and lines are taken whole. An empty
    table gives no rows. Other columns of ``df`` are not read.
    """
    if segment_bits & (segment_bits - 1):
        raise ValueError("segment_bits must be a power of two")
    chunks, total = exchange.chunked(texts(df, id_col, text_col))
    segments = max(1, -(-total // (max(1, least_chars) * segment_hashes)))

    def keys_by_row(table: pa.Table) -> list[set[bytes]]:
        out = []
        for text in table["text"].to_pylist():
            keys = {key_of(line, least_chars) for line in text.split("\n")}
            keys.discard(None)
            out.append(keys)
        return out

    def counted(table: pa.Table) -> tuple[list[set[bytes]], np.ndarray, np.ndarray]:
        rows = keys_by_row(table)
        every = np.fromiter((xxhash.xxh64_intdigest(k) for keys in rows for k in keys), np.uint64)
        return rows, *np.unique(every, return_counts=True)

    def send(table: pa.Table) -> pa.Table:
        _, hashes, n = counted(table)
        edges = exchange.bucket_edges(hashes, segments)
        full = np.flatnonzero(np.diff(edges))
        chunk = table["chunk"][0].as_py()
        return pa.table(
            {
                "segment": pa.array(full, pa.int32()),
                "chunk": pa.array([chunk] * len(full), pa.int32()),
                "hashes": pa.array([hashes[edges[s] : edges[s + 1]].tobytes() for s in full], pa.binary()),
                "again": pa.array([np.packbits(n[edges[s] : edges[s + 1]] > 1).tobytes() for s in full], pa.binary()),
            }
        )

    def filtered(table: pa.Table) -> pa.Table:
        both = TwiceSeen(segment_bits)
        sent = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        for hashes, again in zip(sent, table["again"].to_pylist(), strict=True):
            both.add(hashes, np.unpackbits(np.frombuffer(again, np.uint8), count=len(hashes)).astype(bool))
        marks = [np.packbits(both.suspects(hashes)).tobytes() for hashes in sent]
        return pa.table({"chunk": table["chunk"], "bucket": table["segment"], "marks": pa.array(marks, pa.binary())})

    suspect_type = pa.schema([("chunk", pa.int32()), ("line_key", pa.string()), ("n", pa.int64()), ("largest", pa.int64())])

    def suspected(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return suspect_type.empty_table()
        rows, hashes, _ = counted(table)
        suspects = set(hashes[exchange.marked(hashes, segments, marks)].tolist())
        held: dict[bytes, list] = {}
        for doc, keys in zip(table["doc_id"].to_pylist(), rows, strict=True):
            for k in keys:
                if xxhash.xxh64_intdigest(k) in suspects:
                    mine = held.setdefault(k, [0, None])
                    mine[0] += 1
                    if doc is not None and (mine[1] is None or doc > mine[1]):
                        mine[1] = doc
        chunk = table["chunk"][0].as_py()
        columns = [[chunk] * len(held), [k.decode() for k in held], [n for n, _ in held.values()], [d for _, d in held.values()]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, suspect_type, strict=True)], schema=suspect_type)

    kept_type = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return kept_type.empty_table()
        largest = dict(zip((k.encode() for k in found["line_key"].to_pylist()), found["largest"].to_pylist(), strict=True))
        rows = []
        for doc, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True):
            lines = text.split("\n")
            stay = [x for x in lines if (k := key_of(x, least_chars)) not in largest or largest[k] == doc] if largest else lines
            rows.append((doc, len(lines), len(lines) - len(stay), text if len(stay) == len(lines) else "\n".join(stay)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kept_type, strict=True)], schema=kept_type)

    marks = exchange.dealt(chunks.groupBy("chunk").applyInArrow(send, "segment int, chunk int, hashes binary, again binary"), "segment", segments)
    marks = marks.groupBy("segment").applyInArrow(filtered, "chunk int, bucket int, marks binary")
    suspects = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(suspected, "chunk int, line_key string, n bigint, largest bigint")
    suspects = exchange.dealt(suspects, "line_key", max(1, total // exchange.CHUNK_BYTES))
    common = suspects.groupBy("line_key").agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).where(F.col("n") >= least_documents)
    found = suspects.select("chunk", "line_key").join(common.select("line_key", "largest"), "line_key").select("chunk", "line_key", "largest")
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept string"
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, schema)


def brute_force(rows: list[tuple[int | None, str | None]], least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept_sha256) on a list; for tests."""
    def key(line: str) -> str:
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    held: dict[str, list] = {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(k, []).append(doc)
    gone = {k: max((d for d in docs if d is not None), default=None) for k, docs in held.items() if len(k) >= least_chars and len(docs) >= least_documents}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in gone or gone[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out
