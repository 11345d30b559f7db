"""Texts cut into units that sub-word tokenizers encode alone, and an index of units seen before.

A unit is a run of white space, if any, with what follows it up to the next space.
It begins at a text's start or at a space that follows a character other than
white space.  Neither a byte-level pre-tokenizer that puts a space before a word nor
a piece vocabulary without inner spaces ever joins anything across such a place.

Every text is read with a space before it.  Texts of more than ``limit`` bytes come in
several parts, cut between units, so that memory depends on the longest unit rather
than on the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .kernels import BYTE, PB, SPACE, chunks, mix

_WHITE = SPACE.copy()
_WHITE[0x1C:0x20] = True
#: White space of more than one byte in UTF-8, and U+2581, which piece vocabularies read as a space: last byte, after the bytes before it.
_WIDE = {(0xC2,): [0x85, 0xA0], (0xE1, 0x9A): [0x80], (0xE2, 0x80): [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF], (0xE2, 0x81): [0x9F], (0xE2, 0x96): [0x81], (0xE3, 0x80): [0x80]}


class Part(NamedTuple):
    """Consecutive texts from row on, or a part of one text: bytes with a space before each text, their limits; whether it begins and ends its texts."""

    row: int
    data: np.ndarray
    offsets: np.ndarray
    begins: bool = True
    ends: bool = True


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    out = np.full(len(data) + n, 0x20, dtype=np.uint8)
    at = np.ones(len(out), dtype=bool)
    at[offsets[:-1] + np.arange(n)] = False
    out[at] = data
    return out, offsets + np.arange(n + 1)


def parts(column: pa.Array, limit: int = 1 << 21) -> Iterator[Part]:
    """The texts of a column (null: empty) in parts of about limit bytes."""
    for row, _, data, offsets in chunks(column, limit):
        data, offsets = _spaced(data, offsets)
        if len(data) <= 2 * limit or len(offsets) > 2:
            yield Part(row, data, offsets)
            continue
        cuts = np.flatnonzero(unit_starts(data, offsets))
        at = 0
        while at < len(data):
            near = cuts[max(np.searchsorted(cuts, at + limit, side="right") - 1, 0)]
            if near <= at:  # a unit longer than the limit
                later = cuts[np.searchsorted(cuts, at, side="right") :]
                near = int(later[0]) if len(later) else len(data)
            stop = int(near) if at + limit < len(data) else len(data)
            yield Part(row, data[at:stop], np.array([0, stop - at]), at == 0, stop == len(data))
            at = stop


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks of the bytes at which a unit begins."""
    white = _WHITE[data]
    if (data >= 0x80).any():
        for head, last in _WIDE.items():
            k = len(head)
            wide = np.isin(data[k:], last)
            for j, b in enumerate(head):
                wide &= data[j : len(data) - k + j] == b
            white[k:] |= wide
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = (data[1:] == 0x20) & ~white[:-1]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return begins


class Units:
    """Units of texts laid end to end, each text with a space before it: start and end in data, hash, and first, the index of each text's first unit (the total last)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start = np.flatnonzero(unit_starts(data, offsets))
        self.end = np.append(self.start[1:], len(data))
        self.first = np.searchsorted(self.start, offsets)
        n = len(data)
        up, down = PB.get(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.data = data

    def texts(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


class Seen:
    """Numbers of 64-bit names in order of arrival, found for many at once."""

    def __init__(self):
        self.keys, self.numbers = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def number(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all names, and the index of one occurrence of each new one, in order of its number."""
        distinct, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        self.numbers = np.insert(self.numbers, at[new], len(self.keys) + np.arange(len(new)))
        self.keys = np.insert(self.keys, at[new], distinct[new])
        return self.numbers[np.searchsorted(self.keys, distinct)][inverse], first[new]


class Lists:
    """Growing lists of numbers end to end, the i-th one from start[i] to start[i + 1]."""

    def __init__(self, kind: type = np.int64):
        self.values, self.start = np.empty(0, dtype=kind), np.zeros(1, dtype=np.int64)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values = np.concatenate([self.values, values.astype(self.values.dtype)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the lists which, end to end, and their sizes."""
        return gather(self.values, self.start[which], self.start[which + 1] - self.start[which])


def gather(values: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of values that begin at start, end to end, and their sizes."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - sizes), sizes) + np.arange(total)], sizes
