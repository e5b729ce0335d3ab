"""Word shingles as 64-bit hashes, computed over whole Arrow buffers at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from panelyard.llm.buffers import SPACE_BYTES

_rng = np.random.default_rng(20240229)
#: A random odd number for each byte value, with A-Z as a-z.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_ORDER = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes worked on at once; a longer text is cut after white space.
SLAB = 1 << 19
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLAB + (SLAB >> 1))
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the rows of one slab; a word's hash is a polynomial over its bytes, finalised.

    The hash of a slice is a difference of prefix sums times a power of the base's inverse, so no word is touched alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _tables(n)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    last = np.flatnonzero(ends)
    sums = np.cumsum(np.where(inside, _BYTE[data] * power[:n], np.uint64(0)), dtype=np.uint64)
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    raw = (sums[last] - before) * inverse[first]
    return mix(raw + (last - first + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(offsets, first, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sets end to end, their bounds) for runs of rows: each row's distinct shingles, sorted.

    A row with fewer than ``width`` words has its whole sequence as one shingle; one without words has none.
    """
    rows, at = len(offsets) - 1, 0
    while at < rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB, side="right")) - 1)
        begin, end = int(offsets[at]), int(offsets[stop])
        if end - begin <= SLAB + (SLAB >> 1):
            hashes, row = words(data[begin:end], offsets[at : stop + 1] - begin)
        else:
            parts = []
            while begin < end:
                cut = min(end, begin + SLAB)
                while cut < end and not _SPACE[data[cut - 1]]:
                    cut += 1
                parts.append(words(data[begin:cut], np.array([0, cut - begin]))[0])
                begin = cut
            hashes = np.concatenate(parts)
            row = np.zeros(len(hashes), np.int64)
        counts = np.bincount(row, minlength=stop - at)
        firsts = np.cumsum(counts) - counts
        total = len(hashes)
        rolled = np.zeros(total, np.uint64)
        for j in range(width):
            rolled[: max(0, total - j)] += hashes[j:] * _ORDER[j]
        rolled = mix(rolled)
        sets = []
        for i, (a, c) in enumerate(zip(firsts.tolist(), counts.tolist(), strict=True)):
            if c >= width:
                sets.append(np.unique(rolled[a : a + c - width + 1]))
            elif c:
                sets.append(mix((hashes[a : a + c] * _ORDER[:c]).sum(dtype=np.uint64, keepdims=True) + np.full(1, c, np.uint64) * np.uint64(0xA0761D6478BD642F)))
            else:
                sets.append(np.zeros(0, np.uint64))
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        yield at, np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds
        at = stop


_SEEDS = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(flat: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash signatures (rows x coordinates, int32) of non-empty sets laid end to end."""
    out = np.empty((len(bounds) - 1, coordinates), np.int32)
    if len(out):
        for k in range(coordinates):
            value = (((flat ^ _SEEDS[0, k]) * _SEEDS[1, k]) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(value, bounds[:-1]).view(np.int32)
    return out


def set_hash(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set: a sum of finalised members, so independent of their order."""
    total = np.add.reduceat(mix(flat ^ np.uint64(0x2545F4914F6CDD1D)), bounds[:-1]) if len(bounds) > 1 else np.zeros(0, np.uint64)
    return mix(total + np.diff(bounds).astype(np.uint64)).view(np.int64)
