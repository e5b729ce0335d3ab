"""What a tokenizer made of each piece of text, remembered by hash in arrays and looked up for a whole buffer at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from panelyard.llm.shingles import mix

BYTES = np.arange(256)
LETTER_OR_DIGIT = ((BYTES >= 48) & (BYTES < 58)) | ((BYTES >= 65) & (BYTES < 91)) | ((BYTES >= 97) & (BYTES < 123))
#: Visible ASCII, and of that what is no letter or digit.
SHOWN = (BYTES > 32) & (BYTES < 127)
SIGN = SHOWN & ~LETTER_OR_DIGIT
_rng = np.random.default_rng(41)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tails(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where ASCII signs begin that stand behind an ASCII letter or digit, or behind U+00C0 to U+00FF, at the end of a piece.

    They are a pre-token of their own in byte-level and word-end vocabularies alike. Pieces with ``<|``, with
    which special tokens begin, are left whole.
    """
    plain = np.flatnonzero(~SIGN[data])
    stem = np.searchsorted(plain, last) - 1
    stem = np.where(stem >= 0, plain[stem], -1)
    inside = (stem >= first) & (stem < last - 1)
    stem, first, last = stem[inside], first[inside], last[inside]
    byte, before = data[stem], data[np.maximum(stem - 1, 0)]
    ends_well = LETTER_OR_DIGIT[byte] | (before == 0xC3) & (byte >= 0x80) & (byte != 0x97) & (byte != 0xB7)
    marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    if len(marks):
        ends_well &= np.searchsorted(marks, first) == np.searchsorted(marks, last)
    return stem[ends_well] + 1


class PieceMemory:
    """Ids of pieces by a 64-bit hash of their bytes and number of bytes.

    ``learn`` gives (ids end to end, number of ids of each) for a list of pieces; it sees each new piece once.
    Pieces over ``LONGEST`` bytes aren't remembered. Beyond ``most`` pieces the memory starts afresh. A piece
    costs 20 bytes and its ids, two bytes each.
    """

    LONGEST = 48

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 2_000_000) -> None:
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def look_up(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of the pieces data[first : first + length], which stand in order and apart."""
        if not len(first):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        begin = int(first[0])
        span = np.diff(np.append(first, len(data)))
        place = np.arange(begin, len(data)) - np.repeat(first, span)
        value = _BYTE[data[begin:]] * _POWER[np.minimum(place, 63)]
        if not np.array_equal(span, length):
            value[place >= np.repeat(length, span)] = 0
        hashes = mix(np.add.reduceat(value, first - begin) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        short = length <= self.LONGEST
        found, example, back = np.unique(hashes[short], return_index=True, return_inverse=True)
        raw = data.tobytes()
        at = self._places(found, first[short][example], length[short][example], raw)
        start, size = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        start[short], size[short] = self.first[at][back], self.size[at][back]
        ids = self.ids
        if not short.all():
            long = np.flatnonzero(~short)
            flat, size[long] = self.learn([raw[a : a + n] for a, n in zip(first[long].tolist(), length[long].tolist(), strict=True)])
            start[long] = self.used + np.cumsum(size[long]) - size[long]
            ids = np.concatenate([ids[: self.used], flat])
        ends = np.cumsum(size)
        return ids[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))], size

    def _places(self, hashes: np.ndarray, first: np.ndarray, length: np.ndarray, raw: bytes) -> np.ndarray:
        """Where the sorted hashes stand in ``keys``, after those that are new were learned from an example each."""
        if len(self.keys) + len(hashes) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != hashes[inside]
        if not new.any():
            return at
        flat, size = self.learn([raw[a : a + n] for a, n in zip(first[new].tolist(), length[new].tolist(), strict=True)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint16)])
        self.ids[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.keys = np.insert(self.keys, at[new], hashes[new])
        self.first = np.insert(self.first, at[new], begin)
        self.size = np.insert(self.size, at[new], np.asarray(size, np.int32))
        return np.searchsorted(self.keys, hashes)
