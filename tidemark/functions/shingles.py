"""Hashes of word windows, worked out for Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

#: A word is a run of anything but the six ASCII white-space characters.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: An odd factor has an inverse, so a window's hash is a difference of two running sums.
FACTOR = 0xD6E8FEB86659FD93
INVERSE = pow(FACTOR, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit number for each word, the same on every machine."""
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit number for each window of ``width`` words, from the words' numbers."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = np.full(n, FACTOR, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * np.multiply.accumulate(down), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * np.multiply.accumulate(up)[: n - width + 1])


def shingles(words: list[str], width: int) -> np.ndarray:
    """The distinct windows' numbers, sorted; of fewer words than ``width``, one for all of them."""
    return np.unique(window_hashes(word_hashes(words), max(1, min(width, len(words)))))
