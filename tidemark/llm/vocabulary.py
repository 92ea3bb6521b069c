"""Vocabularies of public tokenizers, and texts cut where every tokenizer of their kind cuts."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import tiktoken


def read_bytes(path: str) -> bytes:
    """A vocabulary file, read by the driver; what is sent to executors is its content, which
    is as large as the vocabulary and no larger."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}


def tiktoken_of(content: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(content), special_tokens={})


class Chunks(dict):
    """The ids of a text, by way of its chunks between single spaces, each worked out once.

    Under the byte-level pattern a single space between two characters that are not white
    space always begins a match, so chunks can be looked up one by one. Texts in which white
    space stands in longer runs around a space are worked out whole. Ids are held as packed
    32-bit numbers; the table is emptied when it has ``most`` entries, and chunks longer than
    ``LONG``, as texts without spaces have, are not held at all.
    """

    LONG = 64
    RUNS = re.compile(r"\s \s|  | $")

    def __init__(self, encode: Callable[[str], bytes], most: int = 250_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(" " + chunk)
        if len(chunk) <= self.LONG:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.RUNS.search(text):
            return self.encode(text)
        if len(self) > self.most:
            self.clear()
        first, *rest = text.split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, rest))
