"""Deduplication with sparse suffix arrays.

Of each document's suffixes only those are retained that start at a minimiser,
the least 8-word hash of some stretch of consecutive windows, chosen by content
so that equal passages retain the same suffixes.  Suffixes that begin with an
8-gram found once in the corpus have no neighbour and are dropped.  The others
are sorted by following and preceding words, so that suffixes with equal contexts on
both sides are neighbours and stand for one.  Each window of ``least`` words that holds
the 8-gram is known by how far it reaches to the left, and hashed; windows found in two
suffixes are repeats, whatever lies between these in suffix order.  Repeats of one
document are merged into maximal ones, and results are those of brute force.

Suffixes meet by more than their 8-gram: those whose windows lie mostly to the right
by the first ``(least + 8) / 2`` words, those whose windows lie mostly to the left by
the words on that side.  So a short line that very many documents share is spread by
what surrounds it, and only a passage of that length gathers suffixes in one task,
where those with equal contexts are counted as one before they are sent.

Context words travel as 32-bit hashes, ``least`` of them to each side, which is
more than the distance between retained suffixes; so repeats of any length are
covered by the union over the suffixes in them.

Defined results: words are runs of non-space, unchanged; null or empty texts
have none; equal rows repeat each other; an empty table gives an empty result;
very long texts are read whole, one at a time; of equal 8-grams in a stretch the leftmost
is its minimiser; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, chunks, mix, sliding_argmin, twice
from .store import inflate, lean, squeezed

SEED = 8
#: Random coefficients by place of a window's hash: words to the right, words to the left.
_COEFFICIENTS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, (2, 1024), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minimisers(words: Words, least: int) -> np.ndarray:
    """Words at which a retained suffix starts."""
    seeds = words.shingles(SEED)
    width = least - SEED + 1
    at = sliding_argmin(seeds, width)
    if not len(at):
        return at
    text = words.text_of_word()
    return np.unique(at[text[: len(at)] == text[least - 1 : least - 1 + len(at)]])


def _anchors(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in chunks(batch.column(1), 1 << 23):
            words = Words(data, offsets)
            at = _minimisers(words, least)
            if not len(at):
                continue
            text, grams = words.text_of_word()[at], words.shingles(SEED)[at].view(np.int64)
            row, pos = keys[a + text].astype(np.int64), (at - words.first[text]).astype(np.int32)
            # those that repeat here are known to be live and dealt by row; one of them stands for all when 8-grams are counted
            known, kept = twice(grams)
            for key, places, live in ((row, known, True), (grams, kept, False)):
                yield pa.RecordBatch.from_arrays([pa.array(key[places]), pa.array(row[places]), pa.array(pos[places]), pa.array(np.full(len(places), live))], names=["anchor", "row", "pos", "live"])


def _live(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, row, pos, live), sorted by anchor, that are live or whose anchor occurs twice or more among the others; state is one row."""
    names = ["row", "pos"]
    last, waiting = None, None
    for batch in batches:
        if (ready := batch.filter(batch.column(3))).num_rows:
            yield pa.RecordBatch.from_arrays([ready.column(1), ready.column(2)], names=names)
        batch = batch.filter(pc.invert(batch.column(3)))
        anchor, row, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(anchor):
            continue
        keep = np.zeros(len(anchor), dtype=bool)
        same = anchor[1:] == anchor[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        if last == anchor[0]:
            keep[0] = True
            if waiting is not None:
                yield pa.RecordBatch.from_arrays([pa.array(waiting[0]), pa.array(waiting[1])], names=names)
        waiting = None if keep[-1] else (row[-1:].copy(), pos[-1:].copy())
        last = int(anchor[-1])
        yield pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array(pos[keep])], names=names)


def _halves(least: int) -> tuple[int, int]:
    """Words that a window shares with all of its kind: so many from the anchor on if it reaches less far to the left than the second number, else that many before the anchor."""
    right = (least + SEED) // 2
    return right, least - right + 1


def _contexts(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, row, pos, stop, right, left) of the suffixes of each text.

    A window that holds the 8-gram holds either the first words from it on, or the last ones before it and
    the 8-gram; a suffix goes to a group for each kind, whose anchor is a hash of those words, with as many
    words to each side as windows of that kind reach.  right and left are hashes of the words
    from pos on and of those before it, nearest first, and stop is -1.  Suffixes that are equal within a batch
    repeat each other there: one of them stands for all, and the span [pos, stop) of each is passed on by row.
    """
    ahead, back = _halves(least)
    names = ["anchor", "row", "pos", "stop", "right", "left"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    for batch in batches:
        texts = pa.array([inflate(x.as_py()) for x in batch.column(2)], type=pa.large_binary()).cast(pa.large_string())
        rows, places = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for a, b, data, offsets in chunks(texts):
            words = Words(data, offsets)
            short = (words.hash >> np.uint64(32)).astype(">u4")
            met: dict[tuple[bytes, bytes, bool], list[tuple[int, int]]] = {}
            for i in range(b - a):
                lo, hi, row = int(words.first[i]), int(words.first[i + 1]), int(rows[a + i])
                for p in sorted(set(places[a + i].as_py())):
                    at = lo + p
                    if hi - at >= ahead:
                        met.setdefault((short[at : min(hi, at + least)].tobytes(), short[max(lo, at - back + 1) : at][::-1].tobytes(), True), []).append((row, p))
                    if p >= back and back <= least - SEED:
                        met.setdefault((short[at : min(hi, at + least - back)].tobytes(), short[max(lo, at - least) : at][::-1].tobytes(), False), []).append((row, p))
            out: list[tuple] = []
            for (right, left, forward), found in met.items():
                n_right, n_left = len(right) // 4, len(left) // 4
                if n_right + n_left < least:
                    continue
                shared = right[: ahead * 4] if forward else b"<" + right[: SEED * 4] + left[: back * 4]
                out.append((xxhash.xxh3_64_intdigest(shared) - (1 << 63), *found[0], -1, right, left))
                if len(found) > 1:
                    out += [(row, row, p - n_left, p + n_right, None, None) for row, p in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)] if out else [pa.array([], type=t) for t in types], names=names)


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes as rows of a matrix, 0 beyond their end, and their number."""
    limits = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=">u4")[limits[0] : limits[-1]].astype(np.uint32) if data is not None else np.empty(0, dtype=np.uint32)
    n = np.diff(limits)
    out = np.zeros((len(column), width), dtype=np.uint32)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(limits[:-1] - limits[0], n)] = flat
    return out, n.astype(np.int32)


def _coefficients(least: int) -> np.ndarray:
    if least > _COEFFICIENTS.shape[1]:
        raise ValueError(f"least must be at most {_COEFFICIENTS.shape[1]}")
    return _COEFFICIENTS


def _reach(anchor: np.ndarray, right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct suffixes of whole anchor groups: how far left the leftmost and the rightmost repeated window that holds the anchor reach (-1 and least if none is)."""
    to_right, to_left = _coefficients(least)
    most, fewest = np.full(len(anchor), -1, dtype=np.int32), np.full(len(anchor), least, dtype=np.int32)
    key = anchor.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(least):
        key += right[:, i] * to_right[i]
    for reach in range(least - SEED + 1):
        ok = np.flatnonzero((n_left >= reach) & (n_right >= least - reach))
        if len(ok) > 1:
            name = mix(key[ok])
            order = np.argsort(name)
            same = np.flatnonzero(name[order[1:]] == name[order[:-1]])
            twice = ok[np.concatenate([order[same], order[same + 1]])]
            most[twice] = reach
            fewest[twice] = np.minimum(fewest[twice], reach)
        key -= right[:, least - reach - 1] * to_right[least - reach - 1]
        key += left[:, reach] * to_left[reach]
    return most, fewest


def _spans(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["row", "s", "e"])


def _compare(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Repeats (row, s, e) among the sorted suffixes, with the spans passed on; the state is the distinct suffixes of one anchor.

    Suffixes with equal contexts repeat each other as far as the contexts reach; only the first of them is kept.
    """
    held: list[list[np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            anchor, row, pos, right, left, n_right, n_left = (np.concatenate(x) for x in zip(*held))
            held.clear()
            most, fewest = _reach(anchor, right, left, n_right, n_left, least)
            ok = most >= 0
            if ok.any():
                yield _spans(row[ok], pos[ok] - most[ok], pos[ok] + least - fewest[ok])

    last = None
    for batch in batches:
        passed = batch.filter(pc.greater_equal(batch.column(3), 0))
        if passed.num_rows:
            yield _spans(*(passed.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))
            batch = batch.filter(pc.less(batch.column(3), 0))
        if not batch.num_rows:
            continue
        anchor, row, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        (right, n_right), (left, n_left) = _padded(batch.column(4), least), _padded(batch.column(5), least)
        now = [anchor, row, pos, right, left, n_right, n_left]
        every = now if last is None else [np.concatenate([h, x]) for h, x in zip(last, now)]
        equal = np.ones(len(every[0]) - 1, dtype=bool)
        for x in (every[0], *every[3:]):
            same = x[1:] == x[:-1]
            equal &= same.all(axis=1) if same.ndim > 1 else same
        known = np.concatenate([[False], equal]) if last is None else np.concatenate([[False], equal])[1:]
        # both sides of an equal pair; the first of a group comes again with each batch that goes on with it
        pair = np.zeros(len(every[0]), dtype=bool)
        pair[1:] |= equal
        pair[:-1] |= equal
        pair &= every[5] + every[6] >= least
        if pair.any():
            yield _spans(every[1][pair], every[2][pair] - every[6][pair], every[2][pair] + every[5][pair])
        last = [x[-1:].copy() for x in every]
        fresh = [x[~known] for x in now]
        cut = int(np.searchsorted(fresh[0], anchor[-1]))
        for some, ends in (([x[:cut] for x in fresh], True), ([x[cut:] for x in fresh], False)):
            if held and held[-1][0][-1] != (some[0][0] if len(some[0]) else anchor[-1]):
                yield from flush()
            if len(some[0]):
                held.append(some)
            if ends and len(some[0]):
                yield from flush()
    yield from flush()


def repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """Word spans [s, e) of least words or more that occur elsewhere: row (xxhash64(doc_id, text)), s, e.."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    anchors = keyed.mapInArrow(lean(lambda it: _anchors(it, least)), "anchor long, row long, pos int, live boolean")
    live = anchors.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(_live), "row long, pos int")
    places = live.groupBy("row").agg(F.collect_set("pos").alias("places"))
    texts = squeezed(keyed)
    context = texts.join(places, "row").select("row", "places", "packed").mapInArrow(lean(lambda it: _contexts(it, least)), "anchor long, row long, pos int, stop int, right binary, left binary")
    return context.repartition("anchor").sortWithinPartitions("anchor", "right", "left").mapInArrow(lean(lambda it: _compare(it, least)), "row long, s int, e int")


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        texts = pa.array([inflate(x.as_py()) for x in batch.column(1)], type=pa.large_binary()).cast(pa.large_string())
        cuts, at = batch.column(2).to_pylist(), 0
        for a, b, data, offsets in chunks(texts):
            words, raw = Words(data, offsets), data.tobytes()
            for i in range(b - a):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in cuts[at] or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                at += 1
                keep = np.ones(hi - lo, dtype=bool)
                for s, e in merged:
                    keep[s:e] = False
                kept = [raw[x:y] for x, y in zip(words.start[lo:hi][keep].tolist(), words.end[lo:hi][keep].tolist())]
                for column, value in zip(out, (hi - lo, hi - lo - len(kept), ",".join(f"{s}:{e}" for s, e in merged), hashlib.sha256(b" ".join(kept)).hexdigest())):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_words", "n_repeated", "spans", "kept_sha256"])


def mark_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """Per document: doc_id, n_words, n_repeated (words in repeats), spans (maximal repeats as s:e in words) and the digest of the words outside them."""
    spans = repeats(docs, least).groupBy("row").agg(F.collect_set(F.struct("s", "e")).alias("cuts"))
    texts = squeezed(docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return texts.join(spans, "row", "left").select("doc_id", "packed", "cuts").mapInArrow(lean(_marked), "doc_id long, n_words long, n_repeated long, spans string, kept_sha256 string")
