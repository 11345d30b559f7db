"""Vectorised word kernels shared by the Arrow-backed operators.

Texts are handled as UTF-8 buffers: a word is a maximal run of bytes other than
0x20 and 0x09-0x0D, all of them ASCII, so byte positions never split a code
point.  Hashes are 64-bit polynomial sums over bytes (then over words) modulo
2**64 with a final mix; equal words or shingles always hash alike and unlike
ones collide with a chance near 2**-57 or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random odd word per byte value, so that a word's hash isn't a plain polynomial of its bytes.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = 0x9E3779B97F4A7C15 | 1
C = 0xD6E8FEB86659FD93
M64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    if n > 1:
        out[1:] = base & M64
        np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


PB, PC = _Powers(B), _Powers(C)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """Words of a few texts laid end to end.

    start, end: byte offsets in data; hash: of each word; first: index of each
    text's first word, with the total as last entry.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        if n == 0:
            self.start = self.end = np.empty(0, dtype=np.int64)
            self.hash = np.empty(0, dtype=np.uint64)
            self.first = np.zeros(len(offsets), dtype=np.int64)
            return
        solid = ~space[self.data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        opens = solid.copy()
        opens[1:] &= ~solid[:-1] | cut[1:n]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:] | cut[1:n]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = PB.get(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE[self.data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of every k consecutive words, texts' limits ignored: n - k + 1 entries or none."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, dtype=np.uint64)
        up, down = PC.get(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) over consecutive texts of about limit bytes each; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offs = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def sliding_argmin(values: np.ndarray, width: int, block: int = 1 << 19) -> np.ndarray:
    """Index of the least of every width consecutive values, the leftmost where the leading 40 bits tie."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    out = np.empty(n, dtype=np.int64)
    low = np.uint64((1 << 24) - 1)
    for a in range(0, n, block):
        b = min(n, a + block)
        part = (values[a : b + width - 1] & ~low) | np.arange(b - a + width - 1, dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            part = np.minimum(part[:-size], part[size:])
            size *= 2
        if rest := width - size:
            part = np.minimum(part[:-rest], part[rest:])
        out[a:b] = (part & low).astype(np.int64) + a
    return out


def twice(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs more than once, in order, and those that are the first of their key, in order."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    known = np.zeros(len(key), dtype=bool)
    known[order[1:][same]] = True
    first = ~known
    known[order[:-1][same]] = True
    return np.flatnonzero(known), np.flatnonzero(first)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow strings over a byte buffer, without a copy of the bytes."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
