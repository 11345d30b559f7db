"""Benchmark decontamination by the CGK embedding, bit sampling and exact edit distance.

The CGK embedding reads a string by a random walk: at every step the walk notes the
word under its pointer and moves on by a random bit that depends on the step and on
that word.  Two strings read with the same bits fall into step again after an edit,
so that edit distance becomes Hamming distance between the words noted.  Items and
all windows of the documents (one starts at every word) are read by a few
independent walks, each as long as the item's own, so that a window's size is that of
the item.  A sample takes a few consecutive steps of a walk; samples are drawn
all along the walk, and a window that agrees with an item in one of them is a
candidate.  Walks of neighbouring windows that meet go on as one, which makes reading
every window cheap.

A candidate says on which diagonal the item lies, give or take its edits.  Around it
the least word edit distance over all stretches is computed exactly.  An exact copy
agrees in every sample, so copies are always found; for items with the most edits
allowed, tests hold recall against brute force (at least 0.95 wherever the edits lie; 0.99
on average).

The items are a stated query set: they are held against all rows in blocks of
bounded size, one pass each, and nothing is shuffled before the matches.

Defined results: words are runs of non-space, A-Z lowered.  An item may differ from
a stretch of text in at most ``share`` of its words.  Null or empty texts
and items match nothing; items of fewer than ``least`` words admit no edits and
are found as exact copies; equal items are reported each; equal rows are searched
separately; of stretches at equal distance the first is reported; very long texts are
searched whole, one text at a time; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import M64, Words, chunks
from .store import lean, unused

#: By least words of an item: its independent walks, and the steps of a walk in one sample.  Short items have fewer samples, so theirs are shorter.
WALKS = ((14, 4, 8), (0, 8, 6))
#: Entries of the bitmap over samples, and of a matrix in which stretches are aligned.
BITMAP, CELLS = 1 << 20, 1 << 19
SCHEMA = "doc_id long, item_id long, start_word long, end_word long, distance int"


def edit_distance(item: list[int], text: list[int], most: int) -> tuple[int, int]:
    """Least word edit distance of item to a prefix of text, and that prefix's length; (most + 1, 0) if above most."""
    if text[: len(item)] == item:
        return 0, len(item)
    there = set(text)
    if sum(w not in there for w in item) > most:  # each such word takes an edit
        return most + 1, 0
    row = list(range(len(text) + 1))
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return most + 1, 0
    best = min(range(len(row)), key=lambda j: (row[j], abs(j - len(item))))
    return (row[best], best) if row[best] <= most else (most + 1, 0)


class Walk:
    """One random walk of the embedding and the samples that items have in it."""

    def __init__(self, seed: int, sample: int, longest: int):
        # a walk takes two steps a word on average, and twice that only with a chance next to nothing
        draw = np.random.Generator(np.random.PCG64([sample, seed])).integers(0, 2**63, (2, 4 * longest + sample), dtype=np.uint64)
        self.moves, self.marks = draw * np.uint64(2) + np.uint64(1)
        self.sample, self.found, self.bitmap = sample, {}, np.zeros(BITMAP, dtype=bool)

    def add(self, item: int, words: np.ndarray) -> None:
        """Samples of an item: every ``sample`` steps, and where a walk ends within its first sample."""
        at, total, taken = 0, 0, False
        for step, (move, mark) in enumerate(zip(self.moves.tolist(), self.marks.tolist())):
            if step % self.sample == 0:
                total = 0
            word = int(words[at])
            total = (total + word * mark) & M64
            moved = at + ((word * move & M64) >> 63)
            if step % self.sample == self.sample - 1 or moved == len(words) and not taken:
                self.found.setdefault(step, []).append((total, item, at))
                taken = True
            at = moved
            if at == len(words):
                return

    def close(self) -> None:
        self.samples = {}
        for step, found in self.found.items():
            found.sort()
            key = np.array([x[0] for x in found], dtype=np.uint64)
            self.bitmap[self._bits(key, step)] = True
            self.samples[step] = key, np.array([x[1:] for x in found], dtype=np.int64)
        self.last = max(self.samples, default=-1)
        self.found = {}

    @staticmethod
    def _bits(key: np.ndarray, step: int) -> np.ndarray:
        return ((key >> np.uint64(44)) ^ np.uint64(step * 40_503 & BITMAP - 1)).astype(np.int64)

    def read(self, own: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Samples in which windows agree with items: the place of the window's pointer, and (item, place of the item's pointer).

        own: hashes of the words, 0 where a text ends and walks stay; windows begin at starts.
        """
        at = starts.copy()
        for step in range(self.last + 1):
            if step % self.sample == 0:
                if step and len(at):  # walks that met go on as one, those that left their text end
                    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                    at = at[own[at] != 0]
                total, moved = np.zeros(len(at), dtype=np.uint64), np.empty(len(at), dtype=np.uint64)
            word = own.take(at)
            total += np.multiply(word, self.marks[step], out=moved)
            if step in self.samples:
                hit = np.flatnonzero(self.bitmap[self._bits(total, step)])
                key, owner = self.samples[step]
                low = np.searchsorted(key, total[hit])
                times = np.searchsorted(key, total[hit], side="right") - low
                if times.any():
                    yield np.repeat(at[hit], times), owner[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
            np.multiply(word, self.moves[step], out=moved)
            np.right_shift(moved, np.uint64(63), out=moved)
            at += moved.view(np.int64)


class Items:
    """A block of items: their word hashes, the edits each may have, and the walks by which they are found."""

    def __init__(self, rows: list[tuple[int, str]], share: float, least: int):
        self.ids, self.words, self.most, self.walks = [], [], [], []
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            words = Words(raw, np.array([0, len(raw)]), lower=True)
            if n := len(words):
                self.ids.append(item)
                self.words.append(words.hash)
                self.most.append(min(int(share * n), n - 1) if n >= least else 0)
        above = None
        for shortest, walks, sample in WALKS:
            own = [i for i, w in enumerate(self.words) if len(w) >= shortest and (above is None or len(w) < above)]
            above = shortest
            for seed in range(walks if own else 0):
                walk = Walk(seed, sample, max(len(self.words[i]) for i in own))
                for i in own:
                    walk.add(i, self.words[i])
                walk.close()
                self.walks.append(walk)
        self.words = [w.view(np.int64) for w in self.words]

    def candidates(self, words: Words) -> np.ndarray:
        """Distinct (item, text, word) for samples in which a window agrees with an item: the item would start at this word without insertions and deletions."""
        text = words.text_of_word()
        starts = np.arange(len(words)) + text
        own = np.zeros(len(words) + len(words.first) - 1, dtype=np.uint64)
        own[starts] = words.hash
        ends, out = words.first + np.arange(len(words.first)), [np.empty((0, 3), dtype=np.int64)]
        for walk in self.walks:
            for place, which in walk.read(own, starts):
                doc = np.searchsorted(ends, place, side="right") - 1
                out.append(np.stack([which[:, 0], doc, place - doc - which[:, 1]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def _starts(self, n: int, signed: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For diagonals of item n in texts of words lo to hi: the least distance of the item to a stretch that starts up to most words off, and the first such start."""
        item, most = self.words[n], self.most[n]
        place = (at - most)[:, None] + np.arange(len(item) + 3 * most)
        inside = (place >= lo[:, None]) & (place < hi[:, None])
        window = signed[np.where(inside, place, 0)]
        # words of the item that the stretch holds: fewer than the item's less the edits can't do
        known = np.unique(item)
        near = np.minimum(np.searchsorted(known, window), len(known) - 1)
        able = ((known[near] == window) & inside).sum(axis=1) >= len(item) - most
        distance, start = np.full(len(at), len(item) + 1), at.copy()
        if able.any():
            distance[able], start[able] = self._least(item, most, window[able], inside[able], at[able])
        return distance, start

    @staticmethod
    def _least(item: np.ndarray, most: int, window: np.ndarray, inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = np.arange(window.shape[1] + 1)
        # from the right, as a stretch may end anywhere; row[:, j] is for a start at the window's word j
        row = np.zeros((len(at), window.shape[1] + 1), dtype=np.int64)
        for a in item[::-1]:
            new = row + 1
            np.minimum(new[:, :-1], row[:, 1:] + ((window != a) | ~inside), out=new[:, :-1])
            row = np.minimum.accumulate((new + steps)[:, ::-1], axis=1)[:, ::-1] - steps
        row = np.where(inside, row[:, :-1], len(item) + 1)[:, : 2 * most + 1]
        best = row.argmin(axis=1)
        return row[np.arange(len(at)), best], at - most + best

    def search(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            rows = []
            for a, b, data, offsets in chunks(batch.column(1), 1 << 19):
                words = Words(data, offsets, lower=True)
                if not len(words) or not self.ids:
                    continue
                pairs, signed = self.candidates(words), words.hash.view(np.int64)
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for n in np.unique(pairs[:, 0]).tolist():
                    own = pairs[np.searchsorted(pairs[:, 0], n) : np.searchsorted(pairs[:, 0], n, side="right")]
                    step = max(1, CELLS // (len(self.words[n]) + 3 * self.most[n]))
                    for part in (own[i : i + step] for i in range(0, len(own), step)):
                        doc = part[:, 1]
                        distance, start = self._starts(n, signed, words.first[doc], words.first[doc + 1], part[:, 2])
                        for i in np.flatnonzero(distance <= self.most[n]).tolist():
                            new = int(distance[i]), int(start[i])
                            best[int(doc[i]), n] = min(best.get((int(doc[i]), n), new), new)
                for (doc, n), (_, at) in sorted(best.items()):
                    item, most, lo = self.words[n].tolist(), self.most[n], int(words.first[doc])
                    distance, length = edit_distance(item, signed[at : min(int(words.first[doc + 1]), at + len(item) + most)].tolist(), most)
                    rows.append((ids[a + doc].as_py(), self.ids[n], at - lo, at - lo + length, distance))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.int32()])], names=[x.split()[0] for x in SCHEMA.split(", ")])


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.2, least: int = 8, block: int = 5_000) -> DataFrame:
    """For each document and item found in it, the place of least distance: doc_id, item_id, start_word, end_word, distance.

    items (item_id, text) is the query set, read in blocks of at most block rows.
    """
    ranked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).orderBy("item_id", "text")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts, rows = [], []
    for r in ranked.toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == block:
            parts.append(source.mapInArrow(lean(Items(rows, share, least).search), SCHEMA))
            rows = []
    if rows or not parts:
        parts.append(source.mapInArrow(lean(Items(rows, share, least).search), SCHEMA))
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item is found, with their columns; rows that equal a leaking one in doc_id and text go too."""
    row = unused(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = leaks(keyed.select(F.col(row).alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(found, row, "left_anti").select(*docs.columns)
