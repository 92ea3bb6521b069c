"""Runs of words that repeat with a period, found from string synchronising sets.

A stretch whose smallest period is q and that is four periods long or longer holds, at the
scale t with t <= q < 2t, a synchronising position s with the same 2t words at s and at s + q,
and s + q is the next place with those words. So pairs of neighbouring equal contexts propose
all such periods, and comparing words from the pair outwards gives the whole stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import rolling
from tidemark.llm.common import WORD, texts

#: A run has this many periods and this many words, at least.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Periods below this one are found by comparing words so far apart; the least scale. A power of two.
SMALL = 8
#: Characters of text that are worked through at a time; a longer text is worked through by itself.
TOGETHER = 1 << 20


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From which word on, and with which period, the rule of the query makes a document of ``n``
    words repeat; None for most."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def stretches(codes: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """The maximal (start, end) of at least ``least`` words in which words ``q`` apart agree."""
    same = codes[q:] == codes[:-q]
    edge = np.flatnonzero(np.diff(np.r_[False, same, False].view(np.int8)))
    starts, ends = edge[::2], edge[1::2] + q
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def prime_factors(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return out + [q] * (q > 1)


def has_smaller(codes: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether a stretch of at least two periods ``q`` has a smaller one that divides it."""
    return any((codes[start : end - d] == codes[start + d : end]).all() for d in (q // p for p in prime_factors(q)))


def equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of ``a`` and ``b`` agree, looking at some twice as many."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def spread(codes: np.ndarray, seed: int) -> np.ndarray:
    return rolling.mixed(codes.astype(np.uint64) + np.uint64(seed << 48))


def synchronising(codes: np.ndarray, t: int, periodic: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Positions selected by the hashes of the ``t`` words that follow: those at which the least
    hash among ``t`` + 1 neighbouring positions is the first one's or the last one's. So equal
    stretches of 2t words are selected alike. Positions whose ``t`` words lie in one of the
    ``periodic`` stretches have no hash: there, neighbours look alike and all would be selected."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.minimum(rolling.windows(spread(codes, seed), t), top - np.uint64(1))
    for a, b in periodic:
        if b - a >= t:
            h[a : b - t + 1] = top
    if len(h) <= t:
        return np.zeros(0, np.int64)
    least = h
    for k in range(t.bit_length() - 1):
        least = np.minimum(least[: len(least) - (1 << k)], least[1 << k :])
    both = np.minimum(least[:-1], least[1:])  # of t + 1 positions
    return np.flatnonzero(((both == h[: len(both)]) | (both == h[t : t + len(both)])) & (both != top))


def next_equal(codes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions among sorted ``at`` from which the same ``width`` words follow, each with
    the next such one. Hashes sort them and words decide: should different words share a hash, other hashes are taken."""
    for seed in range(1, 100):
        h = rolling.windows(spread(codes, seed), width)
        own = at[at < len(h)]
        order = np.argsort(h[own], kind="stable")
        ranked = own[order]
        same = np.flatnonzero(h[ranked[1:]] == h[ranked[:-1]])
        left, right = ranked[same], ranked[same + 1]
        for lo in range(0, len(left), max(1, TOGETHER // width)):
            part = slice(lo, lo + max(1, TOGETHER // width))
            view = np.lib.stride_tricks.sliding_window_view(codes, width)
            if not (view[left[part]] == view[right[part]]).all():
                break
        else:
            return left, right
    raise RuntimeError("no hash tells the words apart")


def find_runs(codes: np.ndarray, starts: np.ndarray, least_periods: int = LEAST_PERIODS, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs in ``codes``: texts' word numbers one after the
    other, each text followed by a number of its own. ``starts`` has the texts' first places.

    Runs of small periods come from comparing words at that distance; these stretches are also
    the periodic ones that ``synchronising`` leaves out at larger scales, with the longer runs
    found at the scales between.
    """
    if least_periods < 4:
        raise ValueError("the proof that all runs are found needs four periods")
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(SMALL, len(codes))):
        for a, b in stretches(codes, q, least_periods * q):
            if not has_smaller(codes, a, b, q):
                found[a, b] = q
    lengths = np.diff(np.r_[starts, len(codes)])
    t = SMALL
    while (long := lengths > least_periods * t).any():  # a length counts the number that follows the text
        place = np.flatnonzero(np.repeat(long, lengths))
        part = codes[place]
        periodic = []
        for (a, b), q in found.items():
            if least_periods * q <= t <= b - a and (i := int(np.searchsorted(place, a))) < len(place) and place[i] == a:
                periodic.append((i, i + b - a))
        left, right = next_equal(part, synchronising(part, t, periodic, 0), 2 * t)
        q = right - left
        near = (q >= t) & (q < 2 * t)
        last_q, reach = 0, -1
        for q, s in sorted(zip(q[near].tolist(), left[near].tolist(), strict=True)):
            if q == last_q and s < reach:
                continue  # in the stretch found last
            ahead, behind = equal_ahead(part[s:], part[s + q :]), equal_ahead(part[:s][::-1], part[: s + q][::-1])
            a, b = s - behind, s + q + ahead
            last_q, reach = q, s + ahead
            if b - a >= least_periods * q and not has_smaller(part, a, b, q):
                found[int(place[a]), int(place[a]) + b - a] = q
        t *= 2
    return sorted((a, b, q) for (a, b), q in found.items() if b - a >= max(least_words, least_periods * q))


def groups_of(sizes: list[int], most: int = TOGETHER) -> Iterator[slice]:
    """Neighbouring texts of about ``most`` characters together."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield slice(lo, i)
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield slice(lo, len(sizes))


def runs_of_texts(ids: list, split: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """(start, end, period) of each text's runs."""
    numbers: dict[str, int] = {}
    parts, starts, n = [], [], 0
    for words in split:
        mine = [numbers.setdefault(w, len(numbers)) for w in words]
        starts.append(n)
        parts.append(mine)
        n += len(mine) + 1
    codes = np.empty(n, np.int64)
    for k, (at, mine) in enumerate(zip(starts, parts, strict=True)):
        codes[at : at + len(mine)] = mine
        codes[at + len(mine)] = len(numbers) + k
    out: list[list[tuple[int, int, int]]] = [[] for _ in split]
    begin = np.array(starts, np.int64)
    for a, b, q in find_runs(codes, begin) if n else []:
        k = int(np.searchsorted(begin, a, side="right")) - 1
        out[k].append((a - starts[k], b - starts[k], q))
    return out


OUT = "doc_id bigint, starts array<int>, lengths array<int>, periods array<int>, collapsed string"
INTS = pa.list_(pa.int32())
TYPE = pa.schema([("doc_id", pa.int64()), ("starts", INTS), ("lengths", INTS), ("periods", INTS), ("collapsed", pa.string())])


def periodic_runs(df: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, starts, lengths and periods of its runs, in words, by start
    and then period, and collapsed: the words that stay, joined by one space.

    A run is a stretch of words with smallest period q, of max(6, 4q) words or more, that no
    neighbouring word extends with that period. Words after a run's first q go. With ``plant``,
    words are first repeated as ``planted`` says.

    Nulls: a null text has no words; a null id is planted nothing. Equal texts have equal runs.
    A text is worked through as a whole by one task, in memory in proportion to it; others are
    taken together up to ``TOGETHER`` characters. An empty table gives no rows. Other columns of
    ``df`` are not read. Nothing is shuffled.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sizes = pc.binary_length(batch["text"]).to_pylist()
            for part in groups_of(sizes):
                some = batch.slice(part.start, part.stop - part.start)
                ids, split = some["doc_id"].to_pylist(), []
                for doc, text in zip(ids, some["text"].to_pylist(), strict=True):
                    words = WORD.findall(text)
                    rule = planted(doc, len(words)) if plant else None
                    if rule:
                        a, p = rule
                        words = words[:a] + (words[a : a + p] * (1 + (len(words) - a) // p))[: len(words) - a]
                    split.append(words)
                columns: list[list] = [[], [], [], [], []]
                for doc, words, runs in zip(ids, split, runs_of_texts(ids, split), strict=True):
                    if runs:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for a, b, q in runs:
                            gone[a + q] += 1
                            gone[b] -= 1
                        words = [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
                    row = (doc, [a for a, _, _ in runs], [b - a for a, b, _ in runs], [q for *_, q in runs], " ".join(words))
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TYPE, strict=True)], schema=TYPE)

    return texts(df, id_col, text_col).mapInArrow(batches, OUT)


def brute_force(doc_id: int | None, text: str | None, plant: bool = True) -> tuple:
    """The query's row for one document, by trying every start and period; for tests."""
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e + q - s
            if e > s and length >= max(6, 4 * q) and not any(all(w[i] == w[i + d] for i in range(s, s + length - d)) for d in range(1, q)):
                runs.append((s, length, q))
            s = e + 1
    runs.sort()
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    collapsed = " ".join(x for i, x in enumerate(w) if i not in gone)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed)]
    return doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest
