"""Passages that texts share, from a sparse suffix array: suffixes at content-selected positions,
sorted by their words, whose neighbours are compared and extended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange, rolling
from tidemark.llm.common import WORD, texts

#: Words of a passage that count as repeated, words of a minimiser, and minimisers of which
#: the least is selected.
PASSAGE, MINIMISER, AMONG = 50, 3, 16


def minimisers(codes: np.ndarray, k: int, among: int) -> np.ndarray:
    """The selected position for each run of ``among`` neighbouring k-word grams: the least
    gram's, the last one's if there are several. Positions never fall."""
    grams = rolling.windows(codes, k)
    if len(grams) < among:
        return np.zeros(0, np.int64)
    least, chosen, width = grams, np.arange(len(grams)), 1
    while width < among:  # of twice as many neighbours, or of as many as there are to be
        step = min(width, among - width)
        later = least[step:] <= least[:-step]
        least, chosen = np.where(later, least[step:], least[:-step]), np.where(later, chosen[step:], chosen[:-step])
        width += step
    return chosen


def among_sorted(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among sorted ``keys``, without going through all the keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def matches(contexts: list[tuple[str, str]], reach: int) -> list[int]:
    """For suffixes that agree in their first words, as (the words that follow these, the words
    before the suffix): by how many words to the left, as bits, a passage may start that another
    of them has too. Each is extended over d words to the left and the rest of a passage to the right."""
    split = [(rest.split(" ") if rest else [], left.split(" ") if left else []) for rest, left in contexts]
    out = [0] * len(contexts)
    for d in range(reach + 1):
        same: dict[tuple, int] = {}
        for i, (rest, left) in enumerate(split):
            if len(left) >= d and len(rest) >= reach - d:
                first = same.setdefault((*left[len(left) - d :], *rest[: reach - d]), i)
                if first != i:
                    out[first] |= 1 << d
                    out[i] |= 1 << d
    return out


#: A suffix with its surroundings, and where it occurs in its chunk: pairs of a text's place and a word's.
ENTRY = "chunk int, at binary, lead string, rest string, before string, again boolean"
ENTRY_TYPE = pa.schema([("chunk", pa.int32()), ("at", pa.binary()), ("lead", pa.string()), ("rest", pa.string()), ("before", pa.string()), ("again", pa.bool_())])
#: Which passages around it are repeated, as the bits of ``mask``; with a ``passage``, whether that one is, is still open.
FOUND = "chunk int, at binary, mask int, passage string"
FOUND_TYPE = pa.schema([("chunk", pa.int32()), ("at", pa.binary()), ("mask", pa.int32()), ("passage", pa.string())])
#: Different suffixes with the same leading words that one task holds at a time.
MOST_TOGETHER = 20_000


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FOUND_TYPE)], schema=FOUND_TYPE)


def compare(reach: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` on suffixes sorted by their words. Neighbours that agree in their leading
    words are compared. Of over ``most`` different ones that agree, all passages around each are given
    out instead, to be sorted themselves."""
    every = (1 << (reach + 1)) - 1

    def passages(chunk: int, at: bytes, lead: str, rest: str, before: str) -> Iterator[tuple]:
        right, left = rest.split(" ") if rest else [], before.split(" ") if before else []
        for d in range(reach + 1):
            if len(left) >= d and len(right) >= reach - d:
                yield chunk, at, 1 << d, " ".join([*left[len(left) - d :], lead, *right[: reach - d]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, contexts, members, whole, large = None, [], [], [], False
        out: list[tuple] = []

        def settle() -> None:
            if len(contexts) > 1:
                out.extend((*m, mask, None) for m, mask, done in zip(members, matches(contexts, reach), whole, strict=True) if mask and not done)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                for chunk, at, lead_, rest, before, again in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if lead_ != lead:
                        if not large:
                            settle()
                        lead, contexts, members, whole, large = lead_, [], [], [], False
                    if again:
                        out.append((chunk, at, every, None))
                    if large:
                        out.extend(passages(chunk, at, lead, rest, before))
                    elif contexts and contexts[-1] == (rest, before):
                        if not whole[-1]:
                            out.append((*members[-1], every, None))
                            whole[-1] = True
                        if not again:
                            out.append((chunk, at, every, None))
                    else:
                        contexts.append((rest, before))
                        members.append((chunk, at))
                        whole.append(again)
                        if len(contexts) > most:
                            for m, c in zip(members, contexts, strict=True):
                                out.extend(passages(*m, lead, *c))
                            contexts, members, whole, large = [], [], [], True
                yield found_batch(out)
                out.clear()
        if not large:
            settle()
        yield found_batch(out)

    return run


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` on ``FOUND`` sorted by passage and mask: of the passages that are still open, those
    that stand beside an equal one. A passage may lie around two suffixes of one text; those with as
    many words before the suffix are copies."""
    last, held = None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            out = []
            for row in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns), strict=True):
                if row[3] is None:
                    out.append(row)
                elif row[2:] != last:
                    last, held = row[2:], row
                else:
                    if held:
                        out.append(held)
                        held = None
                    out.append(row)
            yield found_batch([(*r[:3], None) for r in out])


def shared_passages(
    df: DataFrame, passage: int = PASSAGE, k: int = MINIMISER, among: int = AMONG, together: int = MOST_TOGETHER, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per maximal interval of repeated words: doc_id, start, end (in words, end
    exclusive), n_words of the text and the passage's text.

    A word is repeated if it lies in ``passage`` words in a row that also start anywhere else,
    in the same text or another. Any run of that many words holds the position selected among
    its first grams, and every copy selects the same one, so only suffixes at selected positions
    are retained. They are sifted by a hash of the words that any repeat shares from there on; what
    is left is dealt by these words themselves and sorted by all words up to a passage's end.
    So suffixes that can match stand side by side, as in a suffix array. Neighbours with the same leading words are
    compared and extended to the right and left, word by word: the hash sifts, words decide.

    A chunk of documents sends a suffix with its surroundings once, however often it occurs there, so one that
    a third of all texts hold costs a row a chunk. Where over ``together`` different surroundings
    share their leading words, the passages around them are sorted in place of suffixes; see ``settled``.

    Nulls: a null text has no words; a null id is one more id. Texts of fewer than ``passage``
    words give no row. Repeated rows are copies of each other. An empty table gives no rows.
    Other columns of ``df`` are not read. A text is worked through as a whole by one task.
    """
    if passage < k + among - 1:
        raise ValueError("a passage must hold every gram that is chosen from")
    if among > 31:
        raise ValueError("places among which one is chosen are the bits of a number")
    reach = among - 1  # words from a passage's start to the selected position, at most
    tail = passage - reach  # words from the selected position to the end, at least
    chunks, total = exchange.chunked(texts(df, id_col, text_col))
    few, groups = exchange.buckets_for(total // 40), max(1, total // exchange.CHUNK_BYTES)

    def suffixes(own: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Of each text: the distinct selected positions and their suffixes' hashes; and all hashes."""
        out = []
        for text in own:
            codes = rolling.word_codes(WORD.findall(text))
            starts = max(0, len(codes) - passage + 1)
            chosen = minimisers(codes, k, among)[:starts]
            at = chosen[np.diff(chosen, prepend=-1) > 0]
            out.append((at, rolling.windows(codes, tail)[at] if len(at) else np.zeros(0, np.uint64)))
        return out, np.concatenate([h for _, h in out])

    def in_order(table: pa.Table) -> list[tuple[int | None, str]]:
        """A chunk's texts by id and text, so that a place names the same text whenever the chunk is read."""
        return sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))

    def first_keys(table: pa.Table) -> np.ndarray:
        return np.unique(suffixes(table["text"].to_pylist())[1])

    def send(table: pa.Table, marks: pa.Table) -> pa.Table:
        """Suffixes that may not be alone, with their surroundings, each once."""
        if not table.num_rows:
            return ENTRY_TYPE.empty_table()
        own = [t for _, t in in_order(table)]
        found, every = suffixes(own)
        keys, counts = np.unique(every, return_counts=True)
        keys = keys[(counts > 1) | exchange.marked(keys, few, marks)]
        held: dict[tuple[str, str, str], list[int]] = {}
        for i, (text, (at, h)) in enumerate(zip(own, found, strict=True)):
            shared = at[among_sorted(h, keys)].tolist()
            if shared:
                w = WORD.findall(text)
                for p in shared:
                    context = " ".join(w[p : p + tail]), " ".join(w[p + tail : p + passage]), " ".join(w[max(0, p - reach) : p])
                    held.setdefault(context, []).extend((i, p))
        lead, rest, before = zip(*held, strict=True) if held else ((), (), ())
        at = [np.array(x, "<i4").tobytes() for x in held.values()]
        columns = [[table["chunk"][0].as_py()] * len(held), at, lead, rest, before, [len(x) > 2 for x in held.values()]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, ENTRY_TYPE, strict=True)], schema=ENTRY_TYPE)

    out_type = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("passage", pa.string())])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return out_type.empty_table()
        begin: dict[int, list[np.ndarray]] = {}
        for at, mask in zip(replies["at"].to_pylist(), replies["mask"].to_pylist(), strict=True):
            back = np.flatnonzero(mask >> np.arange(reach + 1) & 1)
            for i, p in np.frombuffer(at, "<i4").reshape(-1, 2).tolist():
                begin.setdefault(i, []).append(p - back)
        rows, own = [], in_order(table)
        for i, parts in begin.items():
            doc, text = own[i]
            w = WORD.findall(text)
            starts = np.concatenate(parts)
            mask = np.zeros(len(w), bool)
            mask[starts[(starts >= 0) & (starts <= len(w) - passage)]] = True
            rows += [(doc, a, b, len(w), " ".join(w[a:b])) for a, b in rolling.spans(rolling.covered(mask, passage, len(w)))]
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out_type)], schema=out_type)

    first = exchange.seen_elsewhere(chunks, first_keys, few)
    entries = chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send, ENTRY)
    array = exchange.dealt(entries, "lead", groups).sortWithinPartitions("lead", "rest", "before").mapInArrow(compare(reach, together), FOUND)
    # what is settled goes by chunk, open passages by their words
    told = array.repartition(min(groups, exchange.MOST_TASKS), F.coalesce("passage", F.col("chunk").cast("string")))
    told = told.sortWithinPartitions("passage", "mask").mapInArrow(settled, FOUND).select("chunk", "at", "mask")
    schema = "doc_id bigint, start int, end int, n_words int, passage string"
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, schema)


def brute_force(rows: list[tuple[int, str | None]], passage: int = PASSAGE) -> list[tuple[int, int, int]]:
    """(doc_id, start, end) on a list, by comparing the words themselves; for tests."""
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen: dict[tuple[str, ...], int] = {}
    for _, w in split:
        for s in range(len(w) - passage + 1):
            seen[tuple(w[s : s + passage])] = seen.get(tuple(w[s : s + passage]), 0) + 1
    out = []
    for i, w in split:
        mask = np.zeros(len(w), bool)
        for s in range(len(w) - passage + 1):
            if seen[tuple(w[s : s + passage])] > 1:
                mask[s : s + passage] = True
        out += [(i, a, b) for a, b in rolling.spans(mask)]
    return out
