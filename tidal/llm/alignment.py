"""Alignment of two tokenizers' tokens over the bytes of a text.

A text with a space before it is encoded by a byte-level vocabulary (A) and by a piece
vocabulary (B).  Each byte gets a label: no token ends there, one of A, one of B, or one
of both.  A regular expression scans the string of labels for the spans up to each
both-label, and the labels counted in a span say how many tokens of A and of B make a
group.  All pairs of an A and a B token of a group are linked.

Units of text that both tokenizers encode alone (see ``units``) are labelled and scanned
once and kept in a bounded pool; texts add up what their units hold.

The documents of an id pair are counted over all documents.  Pairs met in more than the
``HOT``-th part of all (document, pair) rows, of which there can't be more than ``HOT``,
are broadcast; all others are joined by a shuffle, where no key has more rows than that
part.  So neither a broadcast nor a task grows with a pair's share of the documents.

Defined results: a null or empty text, and one whose A or B bytes aren't those of the text
(such as one with U+2581), has no tokens: zeros and an empty digest.  Rows are documents:
equal rows and repeated or null doc_ids are counted each.  Ties for an A id's best pair all
count.  Very long texts are read whole, in parts cut between units; only the distinct pairs
of a document are held together.  An empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentence_pieces import CACHE, PieceEncoder, plain_spaces
from .store import ensure_session, lean, shared_folder
from .units import Lists, Seen, Units, gather, parts

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, pairs array<long>, times array<long>"
#: Pairs that are broadcast, at most.
HOT = 1 << 18
#: Bits of a pair's B id.
B_BITS = 24
#: Pairs of one group listed at a time.
PAIRS = 1 << 21
#: Labels of a byte: no end, an end of A, of B, of both.
LABELS = np.frombuffer(b".abx", dtype=np.uint8)
SPAN = re.compile(rb"[^x]*x")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """A byte-level vocabulary read from a rank file, without special tokens."""

    def __init__(self, file: str):
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spelled = Lists(np.uint8)
        by_id = {i: t for t, i in ranks.items()}
        spelled = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.spelled.extend(np.frombuffer(b"".join(spelled), dtype=np.uint8), np.array([len(s) for s in spelled]))

    def units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units end to end, and their number per unit."""
        # a unit that ends in white space would join the next one's space
        alone = np.array([u[-1:].isspace() or u[-1] >= 0x80 and u.decode()[-1:].isspace() or u[-1] in b"\x1c\x1d\x1e\x1f" for u in units], dtype=bool)
        together = np.flatnonzero(~alone)
        ids = np.array(self.encode(b"".join([units[i] for i in together]).decode()), dtype=np.int64)
        sizes = np.zeros(len(units), dtype=np.int64)
        if len(together):
            ends = np.cumsum(self.spelled.start[ids + 1] - self.spelled.start[ids])
            limits = np.cumsum([len(units[i]) for i in together])
            sizes[together] = np.diff(np.concatenate([[0], np.searchsorted(ends, limits) + 1]))
        if not alone.any():
            return ids, sizes
        lists = np.split(ids, np.cumsum(sizes)[:-1])
        for i in np.flatnonzero(alone).tolist():
            lists[i] = np.array(self.encode(units[i].decode()), dtype=np.int64)
            sizes[i] = len(lists[i])
        return np.concatenate(lists), sizes


def product_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of one group's A and B ids, and how often each is linked."""
    (a, m), (b, n) = (np.unique(x, return_counts=True) for x in (a, b))
    return (a[:, None] << B_BITS | b).ravel(), (m[:, None] * n).ravel()


def summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their times."""
    if not len(key):
        return key, times
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(times[order], first)


class Aligner:
    """Two vocabularies, and a pool of the units aligned before."""

    def __init__(self, ranks: str, pieces: str):
        self.a, self.b = ByteLevel(ranks), PieceEncoder(pieces)
        self.forget()

    def forget(self) -> None:
        self.seen, self.groups = Seen(), []
        self.pairs, self.times = Lists(), Lists()
        #: Columns: tokens of A, of B, groups, links; whether the bytes are the text's own.
        self.counts = np.empty((0, 5), dtype=np.int64)

    def _learn(self, units: list[bytes], sizes: np.ndarray) -> None:
        raw = np.frombuffer(b"".join(units), dtype=np.uint8)
        limits = np.concatenate([[0], np.cumsum(sizes)])
        a, per_a = self.a.units(units)
        b, per_b = self.b.model.encode(*plain_spaces(raw, limits))
        sound = np.ones(len(units), dtype=bool)
        labels = np.zeros(len(raw), dtype=np.uint8)
        for ids, per, spelled, bit in ((a, per_a, self.a.spelled, 1), (b, per_b, self.b.model.spelled, 2)):
            joined, lengths = spelled.take(ids)
            owner = np.repeat(np.arange(len(units)), per)
            total = np.bincount(owner, weights=lengths, minlength=len(units)).astype(np.int64)
            odd = total != sizes
            if not odd.any():
                wrong = np.flatnonzero(joined != raw)
                odd[np.searchsorted(limits, wrong, side="right") - 1] = True
                labels[np.cumsum(lengths) - 1] |= bit
            else:  # bytes end elsewhere in a unit or more: mark the ends of the others
                at = np.cumsum(lengths) - np.concatenate([[0], np.cumsum(total)])[owner] + limits[owner]
                same, _ = gather(joined, (np.cumsum(total) - total)[~odd], total[~odd])
                own, _ = gather(raw, limits[:-1][~odd], sizes[~odd])
                where = np.repeat(np.flatnonzero(~odd), sizes[~odd])
                differs = np.unique(where[same != own])
                labels[at[~odd[owner]] - 1] |= bit
                odd[differs] = True
            sound &= ~odd
        keep = np.repeat(sound, sizes)
        labels, ends = LABELS[labels[keep]], np.cumsum(np.where(sound, sizes, 0))
        a, b = a[np.repeat(sound, per_a)], b[np.repeat(sound, per_b)]
        stop = np.fromiter((m.end() for m in SPAN.finditer(labels.tobytes())), dtype=np.int64)
        groups = np.searchsorted(stop, ends, side="right")
        a_upto = np.concatenate([[0], np.cumsum((labels == LABELS[1]) | (labels == LABELS[3]))])[stop]
        b_upto = np.concatenate([[0], np.cumsum((labels == LABELS[2]) | (labels == LABELS[3]))])[stop]
        in_a, in_b = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
        written = self._written(a, b, in_a, in_b)
        per_group = np.diff(groups, prepend=0)
        begins = groups - per_group
        self.groups += [b";".join(written[i:j]) for i, j in zip(begins.tolist(), groups.tolist())]
        key, times, group = self._links(a, b, a_upto - in_a, b_upto - in_b, in_a, in_b)
        unit = np.repeat(np.arange(len(units)), per_group)
        order = np.argsort(group, kind="stable")
        key, times, unit_of = key[order], times[order], unit[group[order]] if len(group) else group
        self.pairs.extend(key, np.bincount(unit_of, minlength=len(units)))
        self.times.extend(times, np.bincount(unit_of, minlength=len(units)))
        links = np.concatenate([[0], np.cumsum(in_a * in_b)])
        rows = np.stack([np.where(sound, per_a, 0), np.where(sound, per_b, 0), per_group, links[groups] - links[begins], sound], axis=1)
        self.counts = np.concatenate([self.counts, rows])

    @staticmethod
    def _written(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> list[bytes]:
        """Groups as text: ids of A, a bar, ids of B."""
        out, i, j = [], 0, 0
        a_text, b_text = [b"%d" % x for x in a.tolist()], [b"%d" % x for x in b.tolist()]
        for m, n in zip(in_a.tolist(), in_b.tolist()):
            out.append(b",".join(a_text[i : i + m]) + b"|" + b",".join(b_text[j : j + n]))
            i, j = i + m, j + n
        return out

    @staticmethod
    def _links(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs linked, how often, and their group.  Pairs of large groups come summed, all others one by one."""
        large = in_a * in_b > 4096
        small = np.flatnonzero(~large)
        n = (in_a * in_b)[small]
        group = np.repeat(small, n)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        key = a[from_a[group] + k // in_b[group]] << B_BITS | b[from_b[group] + k % in_b[group]]
        found = [(key, np.ones(len(key), dtype=np.int64), group)]
        for g in np.flatnonzero(large).tolist():
            own_a, own_b = a[from_a[g] : from_a[g] + in_a[g]], b[from_b[g] : from_b[g] + in_b[g]]
            step = max(1, PAIRS // len(own_b))
            key, times = summed(*map(np.concatenate, zip(*(product_pairs(own_a[i : i + step], own_b) for i in range(0, len(own_a), step)))))
            found.append((key, times, np.full(len(key), g)))
        return tuple(map(np.concatenate, zip(*found)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
        """Per text, each with a space before it: counts (columns of self.counts, the last one 1 where all units are sound), its groups as text, and its distinct pairs with their times."""
        if len(self.seen) > CACHE:
            self.forget()
        units = Units(data, offsets)
        number, new = self.seen.number(units.hash)
        if len(new):
            self._learn(units.texts(new), units.end[new] - units.start[new])
        counts = self.counts[number]
        sums = np.concatenate([np.zeros((1, 5), dtype=np.int64), np.cumsum(counts, axis=0)])
        sums = sums[units.first[1:]] - sums[units.first[:-1]]
        sums[:, 4] = sums[:, 4] == np.diff(units.first)
        n = len(offsets) - 1
        texts = [b";".join([self.groups[i] for i in number[x:y].tolist()]) for x, y in zip(units.first[:-1].tolist(), units.first[1:].tolist())]
        text = np.repeat(np.arange(n), np.diff(units.first))
        which, often = summed(text << 32 | number, np.ones(len(number), dtype=np.int64))
        unit = which & 0xFFFFFFFF
        key, sizes = self.pairs.take(unit)
        times = self.times.take(unit)[0] * np.repeat(often, sizes)
        owner = np.repeat(which >> 32, sizes)
        order = np.lexsort((key, owner))
        key, owner, times = key[order], owner[order], times[order]
        if not len(key):
            return sums, texts, [(key, times)] * n
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        key, owner, times = key[first], owner[first], np.add.reduceat(times, first)
        limits = np.searchsorted(owner, np.arange(1, n))
        return sums, texts, list(zip(np.split(key, limits), np.split(times, limits)))


_aligners: dict[tuple[str, str], Aligner] = {}


def align_partition(batches: Iterable[pa.RecordBatch], ranks: str, pieces: str) -> Iterator[pa.RecordBatch]:
    if (ranks, pieces) not in _aligners:
        _aligners[ranks, pieces] = Aligner(ranks, pieces)
    align = _aligners[ranks, pieces]
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 33
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        counts, digests, links = [], [], []
        for part in parts(batch.column(1)):
            sums, texts, pairs = align(part.data, part.offsets)
            for got, text, own, size in zip(sums, texts, pairs, np.diff(part.offsets).tolist()):
                if part.begins:
                    if size == 1:  # a text of no character
                        got, text, own = got * 0 + [0, 0, 0, 0, 1], b"", (own[0][:0], own[1][:0])
                    counts.append(got)
                    digests.append(hashlib.sha256(text))
                    links.append([own])
                else:
                    counts[-1] = np.append(counts[-1][:4] + got[:4], counts[-1][4] & got[4])
                    digests[-1].update(b";" + text)
                    links[-1] = [tuple(map(np.concatenate, zip(*links[-1], own)))]
                    links[-1] = [summed(*links[-1][0])]
        count = np.array(counts, dtype=np.int64).reshape(-1, 5)
        sound = count[:, 4] == 1
        count = np.where(sound[:, None], count, 0)
        own = [x[0] if ok else (x[0][0][:0], x[0][1][:0]) for x, ok in zip(links, sound.tolist())]
        limits = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in own])]), type=pa.int32())
        lists = [pa.ListArray.from_arrays(limits, pa.array(np.concatenate([x[i] for x in own]) if own else [], type=pa.int64())) for i in (0, 1)]
        columns = [batch.column(0), *(pa.array(count[:, i]) for i in range(4))]
        columns += [pa.array([d.hexdigest() if n else "" for d, n in zip(digests, count[:, 0].tolist())], type=pa.string())]
        columns += [pa.array(row + np.arange(len(own))), *lists]
        row += len(own)
        yield pa.RecordBatch.from_arrays(columns, names=names)


def aligned(docs: DataFrame, ranks: str, pieces: str) -> DataFrame:
    """One row per document: its counts, the digest of its groups, a number of the row, its distinct id pairs (A id << 24 | B id) and how often each is linked."""
    ensure_session(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(lean(lambda it: align_partition(it, ranks, pieces)), SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each id pair linked, and whether no other pair of its A id has more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    a_id = F.shiftright("pair", B_BITS)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))  # no longer than the vocabulary of A
    return counts.join(F.broadcast(most), a_id == F.col("a_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, ranks: str, pieces: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the module's text).

    ranks: rank file of A; pieces: vocabulary file of B, the same on every machine.
    """
    spark = docs.sparkSession
    ensure_session(spark)
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    aligned(docs, ranks, pieces).write.parquet(f"{folder}/documents")
    rows = spark.read.parquet(f"{folder}/documents")
    pair_counts(rows).write.parquet(f"{folder}/pairs")
    counts = spark.read.parquet(f"{folder}/pairs")
    bound = max((counts.agg(F.sum("n")).first()[0] or 0) // HOT, 1)
    hot, rest = counts.where(F.col("n") > bound), counts.where(F.col("n") <= bound)
    links = rows.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times")).alias("pair", "times"))
    found = links.join(F.broadcast(hot), "pair").unionByName(links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rest.hint("shuffle_hash"), "pair"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
