"""Rabin-Karp hashes of word windows, in 64-bit arithmetic."""

from __future__ import annotations

import numpy as np
import xxhash

#: An odd factor has an inverse, so a window's hash is a difference of two running sums.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
U = np.uint64


def word_codes(words: list[str]) -> np.ndarray:
    """A 64-bit number per word."""
    code = xxhash.xxh64_intdigest
    return np.fromiter(map(code, words), U, len(words))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    if n:
        out[0] = U(1)
    return np.multiply.accumulate(out, dtype=U)


def mixed(x: np.ndarray) -> np.ndarray:
    """The same numbers spread over all 64 bits, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` codes: sum of code * FACTOR^-place, times
    FACTOR^start, so that equal windows agree wherever they stand."""
    n = len(codes)
    if n < width:
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(codes * powers(INVERSE, n), out=sums[1:], dtype=U)
    return mixed((sums[width:] - sums[:-width]) * powers(FACTOR, n - width + 1))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window that begins where ``starts`` is true."""
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:-1]) > 0


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of true places, as (start, end)."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
