"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Each document is encoded and ended by one separator id.  Documents longer than
the window are first cut into full windows; the rests are packed in decreasing
order of length, each into the tightest open window that holds it, found with a
segment tree indexed by remaining capacity.  Packing is done per bounded batch
of rests inside a task, so memory doesn't grow with the input and no shuffle is
needed; a lost task is simply run again and gives the same sequences.

Defined results: a null text is empty and yields the separator alone; equal
rows are packed separately; an empty table gives an empty result; extra columns
are ignored.  Ties in length are packed in input order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SPACE, Words, chunks, strings
from .store import lean

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Rests packed together; they need about 100 bytes each.
BATCH = 100_000
#: Units kept in a worker's pool.
CACHE = 400_000
ONLY_SPACE = np.zeros(256, dtype=bool)
ONLY_SPACE[0x20] = True


class CapacityTree:
    """Counts of open windows by remaining capacity, with a search for the least sufficient one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of need or more with an open window, or -1."""
        t, i = self.tree, need + self.size
        if t[i]:
            return need
        while i > 1:
            if not i & 1 and t[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if t[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every length (each of 1 to window), windows numbered from 0."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    tree, open_at, used = CapacityTree(window), [[] for _ in range(window + 1)], 0
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        room = tree.tightest(need)
        if room < 0:
            room, b = window, used
            used += 1
        else:
            b = open_at[room].pop()
            tree.add(room, -1)
        bins[i], offsets[i] = b, window - room
        if left := room - need:
            open_at[left].append(b)
            tree.add(left, 1)
    return bins, offsets


#: Places where the pre-tokeniser could join white space across a single space, and white space beyond ASCII.
UNSAFE = [x + y for x in "\t\n\v\f\r " for y in "\t\n\v\f\r " if " " in (x, y)] + ["<|", *map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]

#: Bytes without which no text holds white space beyond ASCII's usual ones.
RARE = np.zeros(256, dtype=bool)
RARE[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Ids of texts, equal to those of the tokenizer file.

    Its pre-tokeniser never joins a non-space with a following space.  So a text
    in which no space touches other white space splits at its spaces into units
    that encode alone.  The distinct units of a batch are found by their 64-bit
    hashes; new ones are encoded in one call, parted by the byte lengths of their
    ids, and kept in a bounded pool.  Other texts, and those that may hold a
    special token, are encoded whole.
    """

    def __init__(self, tokenizer: str, ranks: str | None):
        self.file = tokenizer
        self.ordinary, self.lengths = None, None
        self.forget()
        if ranks:
            import base64

            import tiktoken

            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ordinary = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
            self.lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
            for token, i in table.items():
                self.lengths[i] = len(token)

    @cached_property
    def exact(self):
        """The tokenizer itself, read when first needed: it takes some 100 MB."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def forget(self) -> None:
        self.keys = np.empty(0, dtype=np.uint64)
        self.spans = np.empty((0, 2), dtype=np.int64)
        self.pool = np.empty(0, dtype=np.uint32)

    def whole(self, text: str) -> np.ndarray:
        ids = self.ordinary(text) if self.ordinary and "<|" not in text else self.exact.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype=np.uint32)

    def learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        """Adds units, each encoded after a space."""
        joined = b" " + b" ".join(units)
        ids = np.asarray(self.ordinary(joined.decode()), dtype=np.uint32)
        places = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 0x20)
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.append(places[1:], len(joined))) + 1
        self.add(keys, ids, ends)

    def add(self, keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        starts = np.concatenate([[0], ends[:-1]])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.spans = np.insert(self.spans, at, (np.stack([starts, ends], axis=1) + len(self.pool))[order], axis=0)
        self.pool = np.concatenate([self.pool, ids])

    def _known(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in chunks(column, 1 << 22):
            texts = strings(data, offsets)
            raw = data.tobytes()
            space, white = data == 0x20, SPACE[data]
            if not self.ordinary or (space[1:] & white[:-1]).any() or (white[1:] & space[:-1]).any() or b"<|" in raw or RARE[data].any() and any(x in raw.decode() for x in UNSAFE):
                # one such place makes the few texts of this chunk that hold one go the slower way
                for t in texts.to_pylist():
                    if not self.ordinary or any(x in t for x in UNSAFE) or t[-1:] == " " or t[:1] == " ":
                        yield self.whole(t)
                    else:
                        one = np.frombuffer(t.encode(), dtype=np.uint8)
                        yield from self._units(one, np.array([0, len(one)]), t.encode())
            else:
                yield from self._units(data, offsets, raw)

    def _units(self, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> Iterator[np.ndarray]:
        if len(self.keys) > CACHE:
            self.forget()
        words = Words(data, offsets, space=ONLY_SPACE)
        key = words.hash.copy()
        heads = words.first[:-1][np.diff(words.first) > 0]
        heads = heads[words.start[heads] == offsets[:-1][np.diff(words.first) > 0]]
        key[heads] ^= np.uint64(0x5555555555555555)  # at a text's start no space comes before
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._known(distinct))
        is_head = np.zeros(len(key), dtype=bool)
        is_head[heads] = True
        plain, head = new[~is_head[first[new]]], new[is_head[first[new]]]
        cut = lambda at: [raw[s:e] for s, e in zip(words.start[first[at]].tolist(), words.end[first[at]].tolist())]
        if len(plain):
            self.learn(distinct[plain], cut(plain))
        if len(head):
            parts = [self.whole(u.decode()) for u in cut(head)]
            self.add(distinct[head], np.concatenate(parts), np.cumsum([len(p) for p in parts]))
        span = self.spans[np.searchsorted(self.keys, distinct)][inverse]
        sizes = span[:, 1] - span[:, 0]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(span[:, 0] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        limits = np.concatenate([[0], ends])[words.first]
        tail = data[offsets[1:] - 1] == 0x20 if len(data) else np.zeros(len(offsets) - 1, dtype=bool)
        for i in range(len(offsets) - 1):
            if offsets[i + 1] > offsets[i] and tail[i]:
                yield self.whole(raw[offsets[i] : offsets[i + 1]].decode())
            else:
                yield ids[limits[i] : limits[i + 1]]


_encoders: dict[tuple, Encoder] = {}


def pack_partition(batches: Iterable[pa.RecordBatch], tokenizer: str, ranks: str | None, window: int, separator: int) -> Iterator[pa.RecordBatch]:
    if (tokenizer, ranks) not in _encoders:
        _encoders[tokenizer, ranks] = Encoder(tokenizer, ranks)
    encode = _encoders[tokenizer, ranks]
    end, names = np.asarray([separator], dtype="<u4").tobytes(), [x.split()[0] for x in SCHEMA.split(", ")]
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 33
    full: list[tuple] = []
    rests: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal full, rests, number
        rows = full
        if rests:
            bins, offsets = best_fit_decreasing(np.fromiter((r[2] for r in rests), dtype=np.int64, count=len(rests)), window)
            rows = full + [(*r, number + b, o) for r, b, o in zip(rests, bins.tolist(), offsets.tolist())]
            number += int(bins.max()) + 1
        full, rests = [], []
        for a in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*rows[a : a + 50_000])], names=names)

    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
            ids = ids.astype("<u4").tobytes() + end
            total, at = len(ids) // 4, 0
            while total - at >= window:
                full.append((doc, at, window, zlib.crc32(ids[4 * at : 4 * (at + window)]), total, number, 0))
                at += window
                number += 1
            if at < total:
                rests.append((doc, at, total - at, zlib.crc32(ids[4 * at :]), total))
            if len(rests) >= BATCH or len(full) >= BATCH:
                yield from flush()
    yield from flush()


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = 1024, separator: int = 0) -> DataFrame:
    """Pieces of all documents in windows of at most window ids (see the module's text).

    One row per piece: doc_id, start (ids of the document before it), length,
    ids_crc32, doc_tokens, sequence_id, offset.  Each id lies in one piece, and a
    sequence's pieces lie in it without gaps from offset 0.  ranks: the same
    vocabulary as a rank file, for a faster encoder with equal ids.
    """
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).mapInArrow(lean(lambda it: pack_partition(it, tokenizer, ranks, window, separator)), SCHEMA)
