"""Passages that occur elsewhere too, found by counting the hash of every window of words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm import exchange, rolling
from tidemark.llm.common import WORD, texts

WIDTH = 35


def cut(text: str, gone: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``gone``; what lies between other words stays as it is."""
    if not gone:
        return text
    at = [m.span() for m in WORD.finditer(text)]
    parts, last = [], 0
    for start, end in [*gone, (len(at), len(at))]:
        if last < start:
            parts.append(text[at[last][0] : at[start - 1][1]])
        last = end
    return " ".join(parts)


def remove_repeats(
    df: DataFrame, width: int = WIDTH, layout: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``df``: doc_id, kept (the words that stay, joined by one space, or
    with ``layout`` as they stood), n_words, n_removed, starts and ends (the removed intervals,
    in words, end exclusive), and with ``carry`` those columns of ``df`` in a struct ``carried``.

    A word goes if it lies in a window of ``width`` words whose sequence also starts anywhere
    else, in the same text or another; so the first copy goes as well. Windows are judged on
    the input. Every window's Rabin-Karp hash is counted; see ``exchange`` for how. Two
    different windows are taken for equal with a chance of (number of windows) / 2^64 each.

    Nulls: a null text has no words; a null id is one more id. Texts of fewer than ``width``
    words stay whole. Repeated rows are copies of each other. An empty table gives no rows.
    Other columns of ``df`` are not read. A text is worked through as a whole by one task.
    """
    chunks, total = exchange.chunked(texts(df, id_col, text_col, carry))
    buckets = exchange.buckets_for(total // 6)

    def hashes(table: pa.Table) -> list[np.ndarray]:
        return [rolling.windows(rolling.word_codes(WORD.findall(t)), width) for t in table["text"].to_pylist()]

    def distinct(table: pa.Table) -> np.ndarray:
        return np.unique(np.concatenate(hashes(table)))

    def finish(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        own = hashes(table)
        keys, counts = np.unique(np.concatenate(own), return_counts=True)
        keys = keys[(counts > 1) | exchange.marked(keys, buckets, marks)]
        rows = []
        for text, h in zip(table["text"].to_pylist(), own, strict=True):
            words = WORD.findall(text)
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            gone = rolling.covered(keys[at] == h if len(keys) else np.zeros(len(h), bool), width, len(words))
            found = rolling.spans(gone)
            if layout:
                kept = cut(text, found)
            else:
                kept = " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            rows.append((kept, len(words), int(gone.sum()), [s for s, _ in found], [e for _, e in found]))
        columns = list(zip(*rows, strict=True))
        extra = [table["carried"].combine_chunks()] if carry else []
        return pa.table([table["doc_id"].combine_chunks(), *map(pa.array, columns[:3]), pa.array(columns[3], ints), pa.array(columns[4], ints), *extra], names=schema_names)

    ints = pa.list_(pa.int32())
    schema = "doc_id bigint, kept string, n_words bigint, n_removed bigint, starts array<int>, ends array<int>"
    if carry:
        schema += f", carried {chunks.schema['carried'].dataType.simpleString()}"
    schema_names = ["doc_id", "kept", "n_words", "n_removed", "starts", "ends"] + ["carried"] * bool(carry)
    empty = to_arrow_schema(T._parse_datatype_string(schema)).empty_table()
    marks = exchange.seen_elsewhere(chunks, distinct, buckets)
    return chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(finish, schema)


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """The same on a list, by comparing the words themselves; for tests."""
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen: dict[tuple[str, ...], int] = {}
    for _, w in split:
        for s in range(len(w) - width + 1):
            seen[tuple(w[s : s + width])] = seen.get(tuple(w[s : s + width]), 0) + 1
    out = []
    for i, w in split:
        gone = {p for s in range(len(w) - width + 1) if seen[tuple(w[s : s + width])] > 1 for p in range(s, s + width)}
        left = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out
