"""Phrases whose words keep company, counted in tiles of pairs of frequency-ranked numbers.

A phrase of three words is a pair of neighbouring pairs, one of four a pair of those, and so on.
So one step, repeated, counts all: number what is frequent by falling frequency, count pairs of
neighbouring numbers, and number the frequent pairs anew for the next step.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange, rolling
from tidemark.llm.common import keep
from tidemark.operators.grouping import top_per_group

LEAST_COUNT, LONGEST, TOP = 100, 5, 2000
NO_LANG = "und"
#: Characters of text, of one language, that are numbered together.
CHUNK_CHARS = 8 << 20
#: A tile's side, as a power of two: pairs (x, y) with the same x >> SIDE and y >> SIDE share one.
SIDE = 10
CELLS = 1 << (2 * SIDE)
#: A tile, or part of one, is counted densely if it has an entry for every so many cells.
DENSE = 8
#: Entries of a bucket of tiles.
BUCKET_PAIRS, BUCKET_WORDS = 2 << 20, 1 << 20
#: Frequent phrases of one length that keys of 64 bits can tell apart.
MOST_NUMBERS = 1 << 31
BREAKS = ".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(f"[{BREAKS}]|[^ \t{BREAKS}]+")
BREAK = re.compile(f"[{BREAKS}]")


def slices(text: str, most: int = CHUNK_CHARS) -> Iterator[str]:
    """A very long text in parts, cut only where a piece ends."""
    at = 0
    while len(text) - at > most:
        m = BREAK.search(text, at + most)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def squeezed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def opened(data: bytes, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def without_double_breaks(seq: np.ndarray) -> np.ndarray:
    """One -1 for each stretch of them."""
    gone = seq < 0
    gone[1:] &= gone[:-1].copy()
    gone[:1] = False
    return seq[~gone]


def keys_of_pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs of neighbours that are both numbered begin, and their keys, in the order of tiles
    and then cells."""
    x, y = seq[:-1], seq[1:]
    at = np.flatnonzero((x >= 0) & (y >= 0))
    x, y, low = x[at], y[at], (1 << SIDE) - 1
    return at, ((x >> SIDE) << 41) | ((y >> SIDE) << 20) | ((x & low) << SIDE) | (y & low)


def pair_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (1 << SIDE) - 1
    return (keys >> 41 << SIDE) | (keys >> SIDE & low), ((keys >> 20 & 0x1FFFFF) << SIDE) | (keys & low)


def summed(keys: np.ndarray, counts: np.ndarray | None, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts (1 each if None).

    A tile is cut into ``parts`` (a power of two) by the last bits of its cells. Where a part has
    many entries, its cells are addressed directly and summed with bincount; all else is sorted.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    units = (keys >> 20) * parts + (keys & (parts - 1)) if parts > 1 else keys >> 20
    order = np.argsort(units, kind="stable")
    units, keys, counts = units[order], keys[order], None if counts is None else counts[order]
    starts = np.flatnonzero(np.r_[True, units[1:] != units[:-1]])
    ends = np.r_[starts[1:], len(units)]
    cells, shift = CELLS // parts, parts.bit_length() - 1
    sparse = np.ones(len(keys), bool)
    out_keys, out_counts = [], []
    for a, b in zip(*(x[ends - starts >= max(1, cells // DENSE)] for x in (starts, ends)), strict=True):
        sums = np.bincount((keys[a:b] & (CELLS - 1)) >> shift, None if counts is None else counts[a:b], cells)
        full = np.flatnonzero(sums)
        out_keys.append((keys[a] >> 20 << 20) | full << shift | (keys[a] & (parts - 1)))
        out_counts.append(sums[full].astype(np.int64))
        sparse[a:b] = False
    if sparse.any():
        order = np.argsort(keys[sparse])
        rest = keys[sparse][order]
        starts = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
        out_keys.append(rest[starts])
        out_counts.append(np.diff(np.r_[starts, len(rest)]) if counts is None else np.add.reduceat(counts[sparse][order], starts))
    every = np.concatenate(out_keys)
    order = np.argsort(every)
    return every[order], np.concatenate(out_counts)[order]


def numbered_texts(df: DataFrame, lang_col: str, text_col: str, chunk_chars: int) -> DataFrame:
    """(chunk, lang, n, ids, words, counts): texts of one language as numbers of their own words, in
    the order of those words' frequency, with -1 between pieces. One pass, no shuffle."""

    def one(lang: str, ids: array, vocabulary: dict[str, int], seq: int) -> dict:
        local = np.frombuffer(ids, np.int32)
        counts = np.bincount(local[local >= 0], minlength=len(vocabulary))
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order) + 1, np.int32)
        place[order], place[-1] = np.arange(len(order)), -1
        words = list(vocabulary)
        return {
            "chunk": (TaskContext.get().partitionId() << 32) + seq, "lang": lang, "n": int(counts.sum()), "ids": squeezed(without_double_breaks(place[local])),
            "words": [words[i] for i in order.tolist()], "counts": counts[order].tolist(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        seq = 0

        def out(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            for lang in langs:
                ids, vocabulary, _ = held.pop(lang)
                yield pa.RecordBatch.from_pylist([one(lang, ids, vocabulary, seq)], schema=schema)
                seq += 1

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist(), strict=True):
                    for some in slices(text.encode().lower().decode(), chunk_chars):
                        ids, vocabulary, size = held.setdefault(lang, [array("i"), {}, 0])
                        number = vocabulary.setdefault
                        ids.extend([-1 if t in BREAKS else number(t, len(vocabulary)) for t in TOKEN.findall(some)])
                        ids.append(-1)
                        held[lang][2] = size + len(some) + 1
                        if held[lang][2] >= chunk_chars:
                            yield from out([lang])
                if sum(h[2] for h in held.values()) >= 4 * chunk_chars:
                    yield from out(list(held))
        yield from out(list(held))

    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return keep(rows.mapInArrow(run, "chunk bigint, lang string, n bigint, ids binary, words array<string>, counts array<bigint>"), "numbered-texts")


#: What a bucket gives: for each chunk that sent it keys, those that are frequent and their numbers;
#: and the frequent ones themselves.
ANSWER = "chunk bigint, keys binary, numbers binary, id bigint, x bigint, y bigint, a bigint, lang string, word string"
ANSWER_TYPE = pa.schema([
    ("chunk", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary()), ("id", pa.int64()), ("x", pa.int64()), ("y", pa.int64()),
    ("a", pa.int64()), ("lang", pa.string()), ("word", pa.string()),
])


def answer(**columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ANSWER_TYPE], schema=ANSWER_TYPE)


def ranks(counts: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Numbers by falling count. A bucket numbers its own entries, leaving room for the other buckets'
    in between; as entries fall into buckets by a hash, numbers follow the frequency nearly."""
    place = np.empty(len(counts), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    numbers = place * buckets + bucket
    if len(numbers) and numbers.max() >= MOST_NUMBERS:
        raise ValueError("more frequent phrases than keys of 64 bits can tell apart")
    return numbers


def frequent_words(chunks: DataFrame, least: int, buckets: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, lang = batch["chunk"][row].as_py(), batch["lang"][row].as_py()
                words, counts = batch["words"][row].values, np.asarray(batch["counts"][row].values)
                at = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words.to_pylist()), np.int64, len(words))
                order = np.argsort(at, kind="stable")
                edges = np.searchsorted(at[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    mine = order[edges[b] : edges[b + 1]]
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": [b], "chunk": [chunk], "lang": [lang], "keys": [mine.astype(np.int32).tobytes()], "words": [words.take(pa.array(mine))], "counts": [counts[mine].tobytes()]},
                        schema=message,
                    )

    def tally(table: pa.Table) -> pa.Table:
        bucket, chunk_of, lang_of = table["bucket"][0].as_py(), table["chunk"].to_pylist(), table["lang"].to_pylist()
        langs = {x: i for i, x in enumerate(sorted(set(lang_of)))}
        sizes = [len(x) for x in table["words"]]
        words = table["words"].combine_chunks().flatten()
        coded = words.dictionary_encode()
        numbers = np.asarray(coded.indices).astype(np.int64) * len(langs) + np.repeat([langs[x] for x in lang_of], sizes)
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()])
        sums = np.bincount(numbers, counts, len(coded.dictionary) * len(langs)).astype(np.int64)
        often = np.flatnonzero(sums >= least)
        ids = np.full(len(sums), -1, np.int64)
        ids[often] = ranks(sums[often], bucket, buckets)
        names = list(langs)
        frequent = answer(id=ids[often], a=sums[often], lang=[names[i] for i in (often % len(names)).tolist()], word=coded.dictionary.take(pa.array(often // len(names))))
        mine = np.split(ids[numbers], np.cumsum(sizes)[:-1])
        local = [np.frombuffer(x, np.int32) for x in table["keys"].to_pylist()]
        some = [(c, k[m >= 0].astype(np.int64), m[m >= 0]) for c, k, m in zip(chunk_of, local, mine, strict=True) if (m >= 0).any()]
        replies = answer(chunk=[c for c, *_ in some], keys=[squeezed(k) for _, k, _ in some], numbers=[squeezed(m) for *_, m in some])
        return pa.concat_tables([frequent, replies])

    message = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("lang", pa.string()), ("keys", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.binary())])
    sent = chunks.select("chunk", "lang", "words", "counts").mapInArrow(send, "bucket int, chunk bigint, lang string, keys binary, words array<string>, counts binary")
    return keep(exchange.dealt(sent, "bucket", buckets).groupBy("bucket").applyInArrow(tally, ANSWER), "frequent-words")


def frequent_pairs(state: DataFrame, least: int, buckets: int, parts: int, reply: bool) -> DataFrame:
    """Counts pairs of neighbours in ``state`` (chunk, ids), within chunks and then within buckets.
    A bucket gets parts of tiles by a hash, so that a tile that every chunk has is split among many."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, counts = summed(keys_of_pairs(opened(batch["ids"][row].as_py()))[1], None)
                units = ((keys >> 20) * parts + (keys & (parts - 1))).astype(np.uint64)
                at = (rolling.mixed(units) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                edges = np.searchsorted(at[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges)).tolist()
                spans = [order[edges[b] : edges[b + 1]] for b in full]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": full, "chunk": [batch["chunk"][row].as_py()] * len(full),
                        "keys": [squeezed(np.diff(keys[s], prepend=0)) for s in spans], "counts": [squeezed(counts[s].astype(np.int32)) for s in spans],
                    },
                    schema=message,
                )

    def tally(table: pa.Table) -> pa.Table:
        bucket, chunk_of = table["bucket"][0].as_py(), table["chunk"].to_pylist()
        keys = [np.cumsum(opened(x)) for x in table["keys"].to_pylist()]
        counts = np.concatenate([opened(x, np.int32) for x in table["counts"].to_pylist()]).astype(np.int64)
        found, sums = summed(np.concatenate(keys), counts, parts)
        found, sums = found[sums >= least], sums[sums >= least]
        ids = ranks(sums, bucket, buckets)
        x, y = pair_of(found)
        frequent = answer(id=ids, x=x, y=y, a=sums)
        if not reply or not len(found):
            return frequent
        replies = []
        for chunk, mine in zip(chunk_of, keys, strict=True):
            at = np.minimum(np.searchsorted(found, mine), len(found) - 1)
            some = found[at] == mine
            if some.any():
                replies.append((chunk, squeezed(np.diff(mine[some], prepend=0)), squeezed(ids[at[some]].astype(np.int32))))
        return pa.concat_tables([frequent, answer(chunk=[r[0] for r in replies], keys=[r[1] for r in replies], numbers=[r[2] for r in replies])])

    message = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    sent = state.select("chunk", "ids").mapInArrow(send, "bucket int, chunk bigint, keys binary, counts binary")
    return keep(exchange.dealt(sent, "bucket", buckets).groupBy("bucket").applyInArrow(tally, ANSWER), "frequent-pairs")


def renumbered(state: DataFrame, answers: DataFrame, chunks: int, words: bool) -> DataFrame:
    """(chunk, n, ids): each chunk's pairs (of ``words``: its words) by their new numbers, -1 where not
    frequent. Chunks in which nothing is frequent go."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return kind.empty_table()
        packed = table["ids"][0].as_py()
        sent, numbers = replies["keys"].to_pylist(), replies["numbers"].to_pylist()
        if words:
            seq = opened(packed, np.int32)
            new = np.full(max(int(seq.max(initial=-1)), *(int(opened(k).max()) for k in sent)) + 2, -1, np.int64)
            for k, m in zip(sent, numbers, strict=True):
                new[opened(k)] = opened(m)
            seq = new[seq]
        else:
            seq = opened(packed)
            keys = np.concatenate([np.cumsum(opened(k)) for k in sent])
            ids = np.concatenate([opened(m, np.int32) for m in numbers])
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            at, mine = keys_of_pairs(seq)
            place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            new = np.full(max(0, len(seq) - 1), -1, np.int64)
            new[at] = np.where(keys[place] == mine, ids[place], -1)
            seq = new
        seq = without_double_breaks(seq)
        return pa.table([table["chunk"], pa.array([len(seq)], pa.int64()), pa.array([squeezed(seq)], pa.binary())], schema=kind)

    kind = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    left = exchange.dealt(state.select("chunk", "ids"), "chunk", chunks).groupBy("chunk")
    right = answers.where("chunk is not null").select("chunk", "keys", "numbers").groupBy("chunk")
    return keep(left.cogroup(right).applyInArrow(run, "chunk bigint, n bigint, ids binary"), "numbered-phrases")


def joined(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """The phrases that ``pairs`` (id, x, y, a) of ``shorter`` phrases are: the words of x and the last
    word of y. ``firsts`` has the counts of their first 1, 2, ... words, ``lasts`` those of their last 1, 2, ... ones."""
    x = shorter.select(F.col("id").alias("x"), "lang", "phrase", F.array_append("firsts", F.col("a")).alias("firsts"))
    y = shorter.select(F.col("id").alias("y"), F.element_at(F.split("phrase", " "), -1).alias("last"), F.array_append("lasts", F.col("a")).alias("lasts"))
    both = pairs.select("id", "x", "y", "a").join(x, "x").join(y, "y")
    return both.select("id", "x", "y", "a", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "firsts", "lasts")


def counted_phrases(
    df: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, chunk_chars: int = CHUNK_CHARS, bucket_pairs: int = BUCKET_PAIRS, lang_col: str = "lang", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(lang, n): how many words each language has; and (lang, words, phrase, a, firsts, lasts, longer)
    for each phrase of 2 to ``longest`` words found ``least`` times: its count, those of its first
    1, 2, ... words and of its last 1, 2, ... words, and the largest count of a phrase one word longer
    that holds it (null: none)."""
    chunks = numbered_texts(df, lang_col, text_col, chunk_chars)
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    n_chunks, n_words = chunks.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    answers = frequent_words(chunks, least, max(1, -(-n_words // BUCKET_WORDS)))
    none = F.array().cast("array<bigint>")
    shorter = answers.where("id is not null").select("id", "lang", F.col("word").alias("phrase"), "a", none.alias("firsts"), none.alias("lasts"))
    state, parts, tables = chunks, 1, []
    while parts < CELLS and parts * bucket_pairs < n_chunks * CELLS:
        parts *= 2
    for length in range(2, longest + 1):
        state = renumbered(state, answers, max(1, n_chunks), words=length == 2)
        n_numbers = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        answers = frequent_pairs(state, least, max(1, -(-n_numbers // bucket_pairs)), parts, reply=length < longest)
        pairs = answers.where("id is not null").select("id", "x", "y", "a")
        found = keep(joined(pairs, shorter), "phrases")
        ends = found.select(F.col("x").alias("id"), F.col("a").alias("longer")).unionByName(found.select(F.col("y").alias("id"), F.col("a").alias("longer")))
        longer = ends.groupBy("id").agg(F.max("longer").alias("longer"))
        if length > 2:
            tables.append(shorter.withColumn("words", F.lit(length - 1)).join(longer, "id", "left"))
        shorter = found.drop("x", "y")
    tables.append(shorter.withColumn("words", F.lit(longest)).withColumn("longer", F.lit(None).cast("bigint")))
    phrases = tables[0]
    for t in tables[1:]:
        phrases = phrases.unionByName(t)
    return totals, phrases.drop("id")


#: The lowest-scoring cut: after k + 1 words, ties to the smallest k. Decimals of 38 digits hold the products.
CUT = """array_min(transform(arrays_zip(firsts, rests), (c, k) -> struct(
    (cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(c.firsts as decimal(19,0)) * cast(c.rests as decimal(19,0))) as score,
    k as k, c.firsts as l, c.rests as r)))"""


def collocations(
    df: DataFrame,
    least: int = LEAST_COUNT,
    longest: int = LONGEST,
    top: int = TOP,
    chunk_chars: int = CHUNK_CHARS,
    bucket_pairs: int = BUCKET_PAIRS,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The first ``top`` phrases of each language by score, with lang, rank, phrase, a, l, r, n, score.

    Texts, with A-Z in lower case, are cut into pieces at the signs in ``BREAKS`` and these into
    words at spaces and tabs. A phrase is 2 to ``longest`` words in a row in a piece that are found
    ``least`` times or more in the language. With l and r the counts of what stands before and after
    a cut in it and n the language's words, its score is the least floor(1000 a n / (l r)) of all cuts.
    Phrases inside a longer one that is found as often go; as counts only fall with more words,
    looking at phrases longer by one word finds them all.

    Texts are read once and held as numbers of chunks of one language. All exchanges are of sorted
    numbers, packed by bucket: a chunk sends each distinct word or pair once with its count, and gets
    back the numbers of the frequent ones. Chunks, buckets and parts of tiles are bounded and their
    number grows with the input; no vocabulary is held by the driver or by one task.

    Nulls: a null language is ``und``; a null text has no words. Very long texts are cut between
    pieces. Ties go by a and then by the phrase's bytes. Repeated rows count again. An empty table
    gives no rows. Other columns of ``df`` are not read. Over 2^31 frequent phrases of one length
    raise an error.
    """
    totals, phrases = counted_phrases(df, least, longest, chunk_chars, bucket_pairs, lang_col, text_col)
    best = phrases.where("longer is null or longer < a").join(totals, "lang").withColumn("rests", F.reverse("lasts")).withColumn("cut", F.expr(CUT))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("bigint").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are first thinned in many tasks
    some = top_per_group(best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256))), ["lang", "part"], order, top).drop("place", "part")
    return top_per_group(some, ["lang"], order, top).select("lang", F.col("place").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def brute_force(rows: list[tuple[str | None, str | None]], least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP) -> list[tuple]:
    """The same on a list of (lang, text), phrase by phrase; for tests."""
    counts: dict[str, Counter] = defaultdict(Counter)
    totals: Counter = Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or NO_LANG] += len(w)
            for k in range(1, longest + 1):
                counts[lang or NO_LANG].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n, phrases = totals[lang], {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in phrases.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        found = []
        for p, a in phrases.items():
            if 100 * inside[p] < 100 * a:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((lang, " ".join(p), a, left, right, n, score))
        found.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(found[:top], 1)]
    return out
