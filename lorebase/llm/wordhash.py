"""Hashes of words and of runs of words, in numpy, for use inside tasks.

A batch of texts is laid end to end as UTF-8 bytes and hashed at once; memory follows the batch, not the table.
Words are ``[^\\x20\\x09-\\x0D]+``.  Hashes have 64 bits, so two different runs share one with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_RUN = 0xD6E8FEB86659FD93
_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser of shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into stretches of about ``limit`` characters; a longer text stands alone."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """hash of each word, first word of each text (and the end), the bytes, start and end of each word."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(parts) + b" "
    codes = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[codes]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), bounds, data, starts, ends
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) - np.repeat(first, lengths)
    letters = (_LOWER if lower else _BYTES)[codes[inside[1:]]] * powers(_BASE, int(lengths.max()))[at]
    return mix(np.add.reduceat(letters, first) + lengths.astype(np.uint64)), bounds, data, starts, ends


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring words (none if there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_RUN)
        out += hashes[j : n + j]
    return mix(out)


class Runs:
    """Hashes of any runs [lo, hi) of a list of words, by prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(_RUN, n)[:n])))
        self.back = powers(pow(_RUN, -1, 1 << 64), n + 1)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))
