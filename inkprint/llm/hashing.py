"""64-bit hashes of all words of a block of texts at once, in NumPy.

A word's hash is a polynomial over its bytes modulo 2^64, read off prefix sums,
then mixed; it depends on nothing but the word, so every task agrees."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Hash value of a byte, upper and lower case ASCII alike.
FOLDED = _BYTE[_FOLD]
#: Bytes of a word: all but space and \t \n \v \f \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word without punctuation: ASCII letters and digits, and all of other scripts.
PLAIN = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    PLAIN[_lo:_hi] = True


class Words(NamedTuple):
    starts: np.ndarray  # byte positions in the block
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray  # of each text's first word; one more at the end
    heads: list[np.ndarray]  # hashes of the first bytes of each word, as asked for


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[k] = np.cumprod(row, dtype=np.uint64)
    return _POWERS


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, heads: tuple[int, ...] = ()) -> Words:
    """Words (runs of bytes in ``keep``) of the texts data[offsets[i]:offsets[i+1]]."""
    n = len(data)
    on = keep[data]
    first, last = on.copy(), on.copy()
    if n:
        first[1:] &= ~on[:-1]
        last[:-1] &= ~on[1:]
    breaks = offsets[offsets < n]
    first[breaks] = on[breaks]
    breaks = offsets[(offsets > 0) & (offsets <= n)] - 1
    last[breaks] = on[breaks]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty((1 + len(heads), len(starts)), dtype=np.uint64)
    lo = 0
    while lo < len(starts):  # pieces of whole words, so that prefix sums stay short
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _PIECE)))
        a, b = starts[lo], ends[hi - 1]
        up, down = _powers(int(b - a) + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(FOLDED[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        for k, width in enumerate((None, *heads)):
            to = e if width is None else np.minimum(e, s + width)
            out[k, lo:hi] = mix((sums[to] - sums[s]) * down[s] + (to - s).astype(np.uint64))
        lo = hi
    return Words(starts, ends, out[0], np.searchsorted(starts, offsets), list(out[1:]))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each ``width`` hashes in a row."""
    n = len(hashes) - width + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(width if n > 0 else 0):
        total += hashes[k : k + n] * factor[k]
    return mix(total)
