"""Five-word shingle sets and their MinHash values, computed on the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Words are runs of other characters than space and \t \n \v \f \r; A-Z are lower-cased first.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_BASE = 0x9E3779B97F4A7C15
_U64 = np.uint64

#: Bytes hashed at once, and for that many the powers of an odd base modulo 2**64 and of its inverse.
CHUNK = 256 << 10


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps, dtype=np.uint64))
    return tables[0], tables[1]


_POWERS = _powers(CHUNK)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of all texts in order, and the n + 1 positions of the texts in them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _FOLD[data]
    inside = data != 32
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    start = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])) | inside & begins[:-1])
    end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | begins[1:])) + 1
    hashes = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):  # as many whole words as a chunk holds, or one that is longer
        base = start[at]
        stop = max(at + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        chunk = data[base : end[stop - 1]]
        power, inverse = _POWERS if len(chunk) <= CHUNK else _powers(len(chunk))
        total = np.zeros(len(chunk) + 1, np.uint64)
        np.cumsum((chunk.astype(np.uint64) + _U64(1)) * power[: len(chunk)], out=total[1:])
        first, last = start[at:stop] - base, end[at:stop] - base
        hashes[at:stop] = (total[last] - total[first]) * inverse[first]
        at = stop
    hashes += (end - start).astype(np.uint64) * _U64(0xD6E8FEB86659FD93)
    return mix64(hashes), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and the n + 1 positions of the texts in them.

    A text of fewer words than ``width``, but not none, has its whole sequence as one shingle.
    """
    words, at = word_hashes(data, offsets)
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64)) | _U64(1)
    count = len(words)
    rolled = np.zeros(max(0, count - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : count - width + 1 + k] * factors[k] if len(rolled) else rolled
    rolled = mix64(rolled)
    parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(sizes)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = mix64(np.array([np.add.reduce(words[a:b] * factors[: b - a]) + _U64(b - a)], np.uint64))
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds


def digests(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify each set."""
    twice = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ _U64(salt)), dtype=np.uint64)))
        twice.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return twice[0], twice[1]


def minhashes(sets: np.ndarray, bounds: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` MinHash values (rows) of each non-empty set (columns; an empty set's column is 0)."""
    rng = np.random.default_rng(seed)
    salts = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    factors = rng.integers(0, 1 << 63, count, dtype=np.uint64) * _U64(2) + _U64(1)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    out = np.zeros((count, len(bounds) - 1), np.uint64)
    if len(full):
        work = np.empty_like(sets)
        for k in range(count):
            np.bitwise_xor(sets, salts[k], out=work)
            np.multiply(work, factors[k], out=work)
            out[k, full] = np.minimum.reduceat(work, bounds[:-1][full])
    return out
