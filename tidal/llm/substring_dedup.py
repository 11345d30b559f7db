"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: in every window of consecutive words the least of
its 8-word hashes, chosen by content alone, so that equal windows share their
anchor.  Consecutive windows with one anchor form a run, which reaches from the
anchor as far to the left and to the right as it stays the least.  Runs meet by
anchor; within an anchor matches are extended over the runs' windows both ways, and
stretches of windows seen more than once are merged into maximal
repeats, which are cut from their documents.

Windows that repeat within a batch are known as repeats where they are read: their
spans are passed on by row, and one of them stands for all when runs meet.  The windows
over a passage's edges, with other words around it in each document, don't repeat: a
passage in very many documents sends about two runs a document to its anchor's task,
which holds their hashes together.
Only one row per run is shuffled (about one per 14 words), never pairs: a task
sorts its runs by anchor and holds the hashes of one anchor at a time.

Defined results: null or empty texts have no words; a document shorter than the
window keeps all its words; equal rows repeat each other; very long texts are read
whole, one at a time; of equal seeds in a window the leftmost is its anchor; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, chunks, sliding_argmin, twice
from .store import inflate, lean, squeezed

SEED = 8
#: A run with the hashes of its windows, or, where stop isn't 0, a repeat [start, stop) dealt out by row.
RUNS = "anchor long, row long, start int, stop int, windows binary"
NAMES = ["anchor", "row", "start", "stop", "windows"]
CUTS = "row long, s int, e int"


def _stretches(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every stretch of consecutive places of one group."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (group[at[1:]] != group[at[:-1]])
    head = np.flatnonzero(new)
    return at[head], at[np.append(head[1:], len(at)) - 1] if len(at) else at


def _runs(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows by anchor, 6 bytes a window, and repeats within a batch."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in chunks(batch.column(1), 1 << 23):
            words = Words(data, offsets)
            whole = words.shingles(window)
            if not len(whole):
                continue
            seeds = words.shingles(SEED)
            at = sliding_argmin(seeds, window - SEED + 1)
            text = words.text_of_word()
            live = np.flatnonzero(text[: len(whole)] == text[window - 1 :])
            if not len(live):
                continue
            anchor, doc = at[live], text[live]
            place = live - words.first[doc]
            # a stretch of windows is parted where the text or the anchor changes
            group = np.concatenate([[0], np.cumsum((np.diff(live) != 1) | (doc[1:] != doc[:-1]))])
            known, kept = twice(whole[live])
            s, e = _stretches(known, group)
            row = keys[a + doc[s]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(row), pa.array(place[s].astype(np.int32)), pa.array((place[e] + window).astype(np.int32)), pa.nulls(len(s), pa.binary())], names=NAMES)
            group = np.concatenate([[0], np.cumsum((np.diff(group) != 0) | (anchor[1:] != anchor[:-1]))])
            s, e = _stretches(kept, group)
            payload = np.ascontiguousarray(whole[live[kept]]).view(np.uint8).reshape(-1, 8)[:, :6]
            limits = np.concatenate([[0], np.cumsum((e - s + 1) * 6)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seeds[anchor[s]].view(np.int64)),
                    pa.array(keys[a + doc[s]].astype(np.int64)),
                    pa.array(place[s].astype(np.int32)),
                    pa.array(np.zeros(len(s), dtype=np.int32)),
                    pa.BinaryArray.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(limits), pa.py_buffer(np.ascontiguousarray(payload))]),
                ],
                names=NAMES,
            )


def _repeats(anchor: np.ndarray, row: np.ndarray, start: np.ndarray, lengths: np.ndarray, payload: np.ndarray, window: int) -> pa.RecordBatch | None:
    """Maximal stretches of repeated windows within whole anchor groups, as word spans."""
    whole = np.zeros((len(payload), 8), dtype=np.uint8)
    whole[:, :6] = payload
    run = np.repeat(np.arange(len(lengths)), lengths)
    key = (whole.reshape(-1).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ anchor.view(np.uint64)[run]
    known, _ = twice(key)
    if not len(known):
        return None
    head, tail = _stretches(known, run)
    base = np.concatenate([[0], np.cumsum(lengths)])
    r = run[head]
    s = start[r] + head - base[r]
    e = start[r] + tail - base[r] + window
    return pa.RecordBatch.from_arrays([pa.array(row[r]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["row", "s", "e"])


def _extend(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Repeats over runs sorted by anchor; the last anchor of a batch waits for the next batch."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            parts = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            if (out := _repeats(*parts, window)) is not None:
                yield out

    for batch in batches:
        done = pc.greater(batch.column(3), 0)
        if (ready := batch.filter(done)).num_rows:
            yield pa.RecordBatch.from_arrays([ready.column(i) for i in (1, 2, 3)], names=["row", "s", "e"])
        batch = batch.filter(pc.invert(done))
        if not batch.num_rows:
            continue
        anchor, row, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        column = batch.column(4)
        limits = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        payload = np.frombuffer(column.buffers()[2], dtype=np.uint8)[limits[0] : limits[-1]].reshape(-1, 6)
        windows = (limits - limits[0]) // 6
        last = int(np.searchsorted(anchor, anchor[-1]))
        for a, b, ends in ((0, last, True), (last, len(anchor), False)):
            if held and b > a and held[-1][0][-1] != anchor[a]:
                yield from flush()
            if b > a:
                held.append((anchor[a:b], row[a:b], start[a:b], np.diff(windows[a : b + 1]), payload[windows[a] : windows[b]]))
            if ends and b > a:
                yield from flush()
    yield from flush()


def repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Word spans [s, e) of each row that windows occurring elsewhere cover: row, s, e.

    row is xxhash64(doc_id, text).  Spans of one row may overlap.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    runs = keyed.mapInArrow(lean(lambda it: _runs(it, window)), RUNS)
    return runs.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(lambda it: _extend(it, window)), CUTS)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, sha = [], [], []
        texts = pa.array([inflate(x.as_py()) for x in batch.column(1)], type=pa.large_binary()).cast(pa.large_string())
        at = 0
        cuts = batch.column(2).to_pylist()
        for a, b, data, offsets in chunks(texts):
            words = Words(data, offsets)
            raw = data.tobytes()
            for i in range(b - a):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                keep = np.ones(hi - lo, dtype=bool)
                for x in cuts[at] or ():
                    keep[x["s"] : x["e"]] = False
                at += 1
                s, e = words.start[lo:hi][keep].tolist(), words.end[lo:hi][keep].tolist()
                n_words.append(hi - lo)
                n_removed.append(hi - lo - len(s))
                sha.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(s, e)])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()), pa.array(sha, type=pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the digest of the kept words joined by one space."""
    spans = repeats(docs, window).groupBy("row").agg(F.collect_set(F.struct("s", "e")).alias("cuts"))
    texts = squeezed(docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return texts.join(spans, "row", "left").select("doc_id", "packed", "cuts").mapInArrow(lean(_cut), "doc_id long, n_words long, n_removed long, kept_sha256 string")
