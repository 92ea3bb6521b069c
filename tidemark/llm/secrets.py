"""Secrets in texts: fixed forms, and strings so random that a tokenizer cannot shorten them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, texts
from tidemark.llm.vocabulary import read_bytes, tiktoken_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # a run of the class is taken whole, so this drops the shorter ones
#: Strings that might be random.
SHORTEST = 20
CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: Hexadecimal digests of the usual lengths, and UUIDs.
DIGEST = re.compile("(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", re.IGNORECASE)
#: Names and paths: words and short numbers, joined by signs or by a change of case.
IDENTIFIER = re.compile("[-_/+=]*+(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]{1,10}+)[-_/+=]*+)++")
LETTERS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Characters to a token that the words of an identifier have at least; drawn letters have some 1.9.
CHARS_A_NAME_TOKEN = 2.3
#: Fewer characters than this to a token: English has some 4, base64 of random bytes some 1.4.
CHARS_A_TOKEN = 2.0
#: A candidate is tokenized in slices of this length, so that a very long one costs its length.
SLICE = 512


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_identifier(word: str, tokens: Callable[[str], int]) -> bool:
    """Words and numbers by shape, and words by what their letters cost, too: in lower case, as
    upper case is dear in any text, and with a space before where that is cheaper."""
    if not IDENTIFIER.fullmatch(word):
        return False
    parts = [m[0][at : at + SLICE].lower() for m in LETTERS.finditer(word) for at in range(0, len(m[0]), SLICE)]
    return sum(map(len, parts)) >= CHARS_A_NAME_TOKEN * sum(min(tokens(p), tokens(f" {p}")) for p in parts)


def outside(s: int, e: int, apart: list[list[int]], ends: list[int]) -> Iterator[tuple[int, int]]:
    """What is left of [s, e) between the spans ``apart``, which are in order and do not overlap."""
    k = bisect_right(ends, s)
    while k < len(apart) and apart[k][0] < e:
        if apart[k][0] > s:
            yield s, apart[k][0]
        s = apart[k][1]
        k += 1
    if s < e:
        yield s, e


def random_spans(text: str, base: list[tuple[int, int, int]], tokens: Callable[[str], int]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of random strings outside of the spans of ``base``: what is left of a
    candidate on either side of such a span is tried by itself."""
    found, apart = [], []
    for s, _, e in base:
        if apart and s < apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], e)
        else:
            apart.append([s, e])
    ends = [e for _, e in apart]
    for m in CANDIDATE.finditer(text):
        for s, e in outside(*m.span(), apart, ends):
            word = text[s:e]
            if len(word) < SHORTEST or DIGEST.fullmatch(word):
                continue
            if len(word) >= CHARS_A_TOKEN * sum(tokens(word[at : at + SLICE]) for at in range(0, len(word), SLICE)):
                continue
            if not is_identifier(word, tokens):
                found.append((s, 3, e))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def finder(content: bytes, pattern: str) -> Callable[[str], list[tuple[int, int, int]]]:
    encoding = tiktoken_of(content, pattern)

    def spans(text: str) -> list[tuple[int, int, int]]:
        base = base_spans(text)
        return sorted(base + random_spans(text, base, lambda w: len(encoding.encode_ordinary(w))))

    return spans


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def find_secrets(
    df: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) per row of ``df``, by start and then by
    kind as in ``KINDS``; places count code points, ends are exclusive.

    ``assign``, ``access`` and ``hex`` are fixed forms. ``random`` is a string of 20 or more
    characters with fewer than ``CHARS_A_TOKEN`` characters to a token of the vocabulary, that
    is no digest, no identifier (words and numbers, of token-efficient words) and lies in no fixed form; what stands beside one in
    the same run of characters counts by itself.

    Nulls: a null text counts as empty and has no spans; a null doc_id stays null. Texts are
    scanned whole. Repeated rows come out as often as they come in, an empty table gives no
    rows, and other columns of ``df`` are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_bytes(vocabulary or default_vocabulary()))
    one = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(one))])

    def make():
        find = finder(shared.value, pattern)

        def work(batch: pa.RecordBatch) -> dict:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)] for t in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "spans": rows}

        return work

    return texts(df, id_col, text_col).mapInArrow(per_batch(make, schema), "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>")


def redact(
    df: DataFrame, mark: str = "<secret>", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, text_col: str = "text"
) -> DataFrame:
    """``df`` with each secret in its text replaced by ``mark``; spans that overlap become one
    mark. All rows and columns stay; a null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(read_bytes(vocabulary or default_vocabulary()))
    place, names, types = df.columns.index(text_col), df.columns, df.schema

    def clean(text: str | None, find: Callable) -> str | None:
        if not text or not (spans := find(text)):
            return text
        out, last = [], 0
        for s, _, e in spans:
            if s >= last:
                out += [text[last:s], mark]
            last = max(last, e)
        return "".join([*out, text[last:]])

    def run(batches):
        find = finder(shared.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                new = pa.array([clean(t, find) for t in part.column(place).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(part.columns)], names=names)

    return df.mapInArrow(run, types)


def counts_and_spans(found: DataFrame) -> DataFrame:
    """What the registered query reports of ``find_secrets``."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        of("random").alias("n_random"),
    )
