"""Words of a column of texts as 64-bit hashes, computed on whole Arrow buffers.

A-Z count as a-z; words are runs of bytes other than space and tab to carriage return.
The hash of a word is a polynomial over random 64-bit values of its bytes, taken from
running sums, then mixed; two words of up to 64 bytes collide with a chance near 2**-58.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C17  # odd, and 3 modulo 4
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20  # bytes that are hashed at once; longer texts are cut between words

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(7919).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _scan(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of `data`, and where each starts; no word reaches over a cut (sorted positions)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = max(CHUNK, 1 << (n - 1).bit_length())
    word = ~SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    begins[inner] |= word[inner]
    ends[inner - 1] |= word[inner - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    sums = np.cumsum(_VALUE[data] * _powers(BASE, size)[:n], dtype=np.uint64)
    before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
    return mix((sums[end] - before) * _powers(INVERSE, size)[begin]), begin


def _long_text(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text of any length, a chunk at a time."""
    out, start = [], 0
    while start < len(data):
        stop = min(len(data), start + CHUNK)
        while stop < len(data):
            gap = np.flatnonzero(SPACE[data[start:stop]])
            if len(gap):
                stop = start + int(gap[-1]) + 1
                break
            stop = min(len(data), stop + CHUNK)
        out.append(_scan(data[start:stop], np.empty(0, np.int64))[0])
        start = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of consecutive texts: index of the first, all hashes, and the bounds of each text in them.

    A null is an empty text.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        base = offsets[first]
        last = int(np.searchsorted(offsets, base + CHUNK, side="right")) - 1
        if last <= first:
            hashes = _long_text(data[base : offsets[first + 1]])
            yield first, hashes, np.array([0, len(hashes)])
            first += 1
            continue
        cuts = offsets[first : last + 1] - base
        hashes, begin = _scan(data[base : offsets[last]], cuts)
        yield first, hashes, np.searchsorted(begin, cuts)
        first = last
