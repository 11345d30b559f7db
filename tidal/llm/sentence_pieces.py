"""Encoding and decoding with a piece vocabulary (byte-pair merges of characters, byte fallback), in vectorised merge rounds.

The symbols of all new units of a batch lie in one flat array.  In each round every
word merges the pair of least rank that it holds, at all its places from left to
right, for all words at once; places are given up for the round from where a merge
made a neighbouring pair that comes before them.  Then the array is compacted, and
words without a pair leave.  The result is that of merging one pair at a time, best
score first and leftmost among equals.

A word is cut further where two characters stand side by side in no piece, as no
merge can cross such a place.  Units are encoded once and kept in a bounded pool.
No shuffle: each document is encoded and decoded where it is read.

Defined results: a null or empty text has the end id alone, which decodes to an empty
text; equal rows and repeated doc_ids are encoded each for itself; ties in rank go to the
leftmost pair; very long texts are read whole, in parts cut between units (one unbroken
unit of a million characters takes rounds over all of it, in the order of a minute); an
empty table gives an empty result; extra columns are ignored, whatever their names.
U+2581 counts as a space, as the vocabulary writes spaces so.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ensure_session, lean
from .units import Lists, Seen, Units, gather, parts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Units kept in a worker's pool.
CACHE = 400_000
#: Kinds of pieces in a vocabulary file.
NORMAL, UNKNOWN, CONTROL, BYTE_KIND = 1, 2, 3, 6
NONE = np.iinfo(np.int32).max
SPACE_MARK = "▁".encode()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}[tag & 7] if tag & 7 != 2 else varint()
            yield tag >> 3, data[at : at + n]
            at += n


class PieceModel:
    """A vocabulary file read into arrays: pieces, ranks by falling score, merges of two pieces, and pairs of characters that pieces hold."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            fields = list(_fields(f.read()))
        self.pieces, scores, kinds = [], [], []
        for message in (v for n, v in fields if n == 1):
            piece = {3: NORMAL} | dict(_fields(message))
            self.pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece[3])
        trainer, normalizer = ({x: y for n, v in fields if n == k for x, y in _fields(v)} for k in (2, 3))
        if trainer.get(3, 1) != 2 or trainer.get(24) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only merge vocabularies that leave texts as they are but for a space before them can be read")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE_KIND} or kinds.count(BYTE_KIND) != 256:
            raise ValueError("only vocabularies with byte fallback and without own symbols can be read")
        self.kind, self.size = np.array(kinds), len(kinds)
        own = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        if any("▁" in p.lstrip("▁") for p in own):
            raise ValueError("pieces with inner spaces can't be read")
        self.rank = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int32)
        merges = {own[p[:k]] * self.size + own[p[k:]]: i for p, i in own.items() for k in range(1, len(p)) if p[:k] in own and p[k:] in own}
        self.merge_key = np.array(sorted(merges), dtype=np.int64)
        self.merge_to = np.array([merges[k] for k in self.merge_key.tolist()], dtype=np.int32)
        self.char = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in own.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x20] = self.char[0x2581]
        beside = {int(self.char[ord(a)]) * self.size + int(self.char[ord(b)]) for p in own for a, b in zip(p, p[1:])}
        self.beside = np.array(sorted(beside), dtype=np.int64)
        self.byte_id = np.full(256, -1, dtype=np.int64)
        for i in np.flatnonzero(self.kind == BYTE_KIND).tolist():
            self.byte_id[int(self.pieces[i][3:5], 16)] = i
        self.end = self.pieces.index("</s>")
        spelled = [bytes([int(p[3:5], 16)]) if k == BYTE_KIND else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace("▁", " ").encode() for p, k in zip(self.pieces, kinds)]
        self.spelled = Lists(np.uint8)
        self.spelled.extend(np.frombuffer(b"".join(spelled), dtype=np.uint8), np.array([len(s) for s in spelled]))
        self.spaced = np.array([s[:1] == b" " for s in spelled]) & (self.kind == NORMAL)

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the pieces that pairs of symbols make; NONE and -1 where they make none."""
        key = np.where((left < self.size) & (right < self.size), left.astype(np.int64) * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
        to = np.where(self.merge_key[at] == key, self.merge_to[at], -1)
        return np.where(to >= 0, self.rank[to], NONE).astype(np.int32), to

    def symbols(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the characters of UTF-8 bytes (size + code point where no piece is one), and the byte at which each begins."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at].astype(np.int32)
        wide = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], dtype=np.int32)[wide]
        for k in (1, 2, 3):
            longer = wide > k
            code[longer] = code[longer] << 6 | (data[at[longer] + k] & 0x3F)
        return self.char[code], at

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each word after all merges, and their number per word.  first: where words begin, none of them empty."""
        word = np.zeros(len(symbols), dtype=np.int64)
        word[first[1:]] = 1
        word = np.cumsum(word)
        done, left_of = [], np.zeros(len(first), dtype=np.int64)
        rank, to = np.full(len(symbols), NONE, dtype=np.int32), np.full(len(symbols), -1, dtype=np.int32)

        def refresh(at: np.ndarray) -> None:
            """Ranks of the pairs that begin at the places at."""
            rank[at], to[at] = NONE, -1
            at = at[at + 1 < len(symbols)]
            at = at[word[at] == word[at + 1]]
            rank[at], to[at] = self.merged(symbols[at], symbols[at + 1])

        refresh(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((word[gone], symbols[gone]))
                left_of[word[starts[over]]] = sizes[over]
                symbols, word, rank, to = symbols[~gone], word[~gone], rank[~gone], to[~gone]
                least, sizes = least[~over], sizes[~over]
                if not len(symbols):
                    break
            best = rank == np.repeat(least, sizes)
            # of pairs that overlap, each second one from the left
            at = np.flatnonzero(best)
            fresh = np.append(True, np.diff(at) > 1)
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            at = self._in_order(symbols, word, rank, to, at)
            symbols[at] = to[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # where they lie after the compaction
            symbols, word, rank, to = symbols[keep], word[keep], rank[keep], to[keep]
            refresh(np.unique(np.concatenate([at, at[at > 0] - 1])))
        words = np.concatenate([w for w, _ in done]) if done else np.empty(0, dtype=np.int64)
        out = np.concatenate([s for _, s in done]) if done else symbols
        return out[np.argsort(words, kind="stable")], left_of

    def _in_order(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, to: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The places at without those that come, in their word, after a merge that makes a pair of their rank or a better one."""
        made, own = to[at], rank[at]
        near = np.append(False, (at[1:] == at[:-1] + 2) & (word[at[1:]] == word[at[:-1]]))
        before = np.where(near, np.append(-1, made[:-1]), symbols[np.maximum(at - 1, 0)])
        has_left = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
        after = np.minimum(at + 2, len(symbols) - 1)
        has_right = (at + 2 < len(symbols)) & (word[after] == word[at])
        early = has_left & (self.merged(before, made)[0] <= own) | has_right & (self.merged(made, symbols[after])[0] <= own)
        if not early.any():
            return at
        seen = np.cumsum(early) - early  # such merges before each place
        opens = np.append(True, word[at[1:]] != word[at[:-1]])
        base = seen[np.flatnonzero(opens)][np.cumsum(opens) - 1]
        return at[seen == base]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts end to end, without the space that stands before a text, and their number per text."""
        if not len(data):
            return np.empty(0, dtype=np.int64), np.zeros(len(offsets) - 1, dtype=np.int64)
        symbols, at = self.symbols(data)
        text = np.searchsorted(offsets, at, side="right") - 1
        key = symbols[:-1].astype(np.int64) * self.size + symbols[1:]
        key[(symbols[:-1] >= self.size) | (symbols[1:] >= self.size)] = -1
        place = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        cut = np.append(True, (self.beside[place] != key) | (text[1:] != text[:-1]))
        first = np.flatnonzero(cut)
        ids, per = self.merge(symbols, first)
        owner = np.repeat(text[first], per)
        ids = ids.astype(np.int64)
        if (ids >= self.size).any():  # characters without a piece, byte by byte
            wide = np.where(ids >= self.size, 1 + (ids - self.size >= 0x80) + (ids - self.size >= 0x800) + (ids - self.size >= 0x10000), 1)
            ids, owner, k = np.repeat(ids, wide), np.repeat(owner, wide), np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            wide = np.repeat(wide, wide)
            code = ids - self.size
            low = code >> 6 * (wide - 1 - k)
            head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide]
            byte = np.where(k == 0, low | head, low & 0x3F | 0x80)
            ids = np.where(code >= 0, self.byte_id[np.where(code >= 0, byte, 0)], ids)
        return ids, np.bincount(owner, minlength=len(offsets) - 1)

    def decode(self, ids: np.ndarray, sizes: np.ndarray, begins: bool = True) -> list[bytes]:
        """UTF-8 texts of lists of ids end to end.  begins: whether they begin a text, where one space at the front isn't the text's own."""
        ids = ids.astype(np.int64)
        limits = np.concatenate([[0], np.cumsum(sizes)])
        out, lengths = self.spelled.take(ids)
        ends = np.concatenate([[0], np.cumsum(lengths)])[limits]
        raw = out.tobytes()
        skip = np.zeros(len(sizes), dtype=np.int64)
        if begins:
            told = np.flatnonzero(self.kind[ids] != CONTROL)
            first = np.searchsorted(told, limits[:-1])
            has = first < len(told)
            has[has] = told[first[has]] < limits[1:][has]
            skip[has] = self.spaced[ids[told[first[has]]]]
        try:
            raw.decode()
            cut_well = (out[ends[:-1][ends[:-1] < len(out)]] & 0xC0 != 0x80).all()
        except UnicodeDecodeError:
            cut_well = False
        if cut_well:
            return [raw[a + s : b] for a, s, b in zip(ends[:-1].tolist(), skip.tolist(), ends[1:].tolist())]
        return [self._mended(ids[a:b])[s:] for a, b, s in zip(limits[:-1].tolist(), limits[1:].tolist(), skip.tolist())]

    def _mended(self, ids: np.ndarray) -> bytes:
        """Text of ids whose byte pieces may not be UTF-8: each byte that begins no character becomes U+FFFD."""
        out, at = [], 0
        is_byte = self.kind[ids] == BYTE_KIND
        while at < len(ids):
            stop = at + 1
            while stop < len(ids) and is_byte[stop] == is_byte[at]:
                stop += 1
            raw = self.spelled.take(ids[at:stop])[0].tobytes()
            if is_byte[at]:
                i = 0
                while i < len(raw):
                    for k in (1, 2, 3, 4):
                        try:
                            out.append(raw[i : i + k].decode().encode())
                            i += len(out[-1])
                            break
                        except UnicodeDecodeError:
                            continue
                    else:
                        out.append("�".encode())
                        i += 1
            else:
                out.append(raw)
            at = stop
        return b"".join(out)


class PieceEncoder:
    """A PieceModel with a pool of the units encoded before."""

    def __init__(self, file: str):
        self.model = PieceModel(file)
        self.forget()

    def forget(self) -> None:
        self.seen, self.ids = Seen(), Lists(np.int32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each with a space before it, end to end, and their number per text."""
        if len(self.seen) > CACHE:
            self.forget()
        data, offsets = plain_spaces(data, offsets)
        units = Units(data, offsets)
        number, new = self.seen.number(units.hash)
        if len(new):
            sizes = units.end[new] - units.start[new]
            raw, _ = gather(data, units.start[new], sizes)
            self.ids.extend(*self.model.encode(raw, np.concatenate([[0], np.cumsum(sizes)])))
        ids, sizes = self.ids.take(number)
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[units.first])


def plain_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with U+2581 written as a space."""
    mark = np.zeros(len(data), dtype=bool)
    mark[: len(data) - 2] = (data[:-2] == SPACE_MARK[0]) & (data[1:-1] == SPACE_MARK[1]) & (data[2:] == SPACE_MARK[2])
    if not mark.any():
        return data, offsets
    at = np.flatnonzero(mark)
    data = data.copy()
    data[at] = 0x20
    keep = np.ones(len(data), dtype=bool)
    keep[at + 1] = keep[at + 2] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


_encoders: dict[str, PieceEncoder] = {}


def encoder(file: str) -> PieceEncoder:
    """The worker's encoder of a vocabulary file."""
    if file not in _encoders:
        _encoders[file] = PieceEncoder(file)
    return _encoders[file]


def _digest_partition(batches: Iterable[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(file)
    model = encode.model
    names = [str(i) for i in range(model.size)]
    end = str(model.end)
    for batch in batches:
        counts, id_digests, text_digests = [], [], []
        for part in parts(batch.column(1)):
            ids, sizes = encode(part.data, part.offsets)
            if part.begins and len(sizes):  # texts of no character have no ids
                empty = np.diff(part.offsets) == 1
                keep = np.repeat(~empty, sizes)
                ids, sizes = ids[keep], np.where(empty, 0, sizes)
            texts, at = model.decode(ids, sizes, part.begins), 0
            for n, text in zip(sizes.tolist(), texts):
                if part.begins:
                    counts.append(0)
                    id_digests.append(hashlib.sha256())
                    text_digests.append(hashlib.sha256())
                counts[-1] += n
                if n:
                    id_digests[-1].update((" ".join([names[i] for i in ids[at : at + n].tolist()]) + " ").encode())
                text_digests[-1].update(text)
                if part.ends:
                    counts[-1] += 1
                    id_digests[-1].update(end.encode())
                at += n
        columns = [batch.column(0), pa.array(counts, type=pa.int64()), pa.array([d.hexdigest() for d in id_digests], type=pa.string()), pa.array([d.hexdigest() for d in text_digests], type=pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def _encode_partition(batches: Iterable[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(file)
    end = np.array([encode.model.end])
    for batch in batches:
        out: list[list[np.ndarray]] = []
        for part in parts(batch.column(-1)):
            ids, sizes = encode(part.data, part.offsets)
            empty = np.diff(part.offsets) == 1 if part.begins else np.zeros(len(sizes), dtype=bool)
            for one, bare in zip(np.split(ids, np.cumsum(sizes)[:-1]), empty.tolist()):
                if part.begins:
                    out.append([])
                out[-1] += [one] * (not bare) + [end] * part.ends
        sizes = np.array([sum(map(len, x)) for x in out], dtype=np.int64)
        flat = np.concatenate([y for x in out for y in x]) if out else np.empty(0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32()), pa.array(flat, type=pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "ids"])


def _decode_partition(batches: Iterable[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    model = encoder(file).model
    for batch in batches:
        lists = batch.column(-1)
        known = [[i for i in x if i is not None and 0 <= i < model.size] for x in lists.fill_null([]).to_pylist()]
        texts = model.decode(np.array([i for x in known for i in x], dtype=np.int64), np.array([len(x) for x in known], dtype=np.int64))
        texts = [t.decode() if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, type=pa.string())], names=[*batch.schema.names[:-1], "text"])


def encode(docs: DataFrame, file: str) -> DataFrame:
    """docs with the column text (null: empty) replaced by ids, an array that ends in the end id; it comes last."""
    ensure_session(docs.sparkSession)
    others = [c for c in docs.columns if c.lower() not in ("text", "ids")]
    kept = docs.select(*(F.col(f"`{c}`") for c in others), F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["ids array<int>"])
    return kept.mapInArrow(lean(lambda it: _encode_partition(it, file)), schema)


def decode(rows: DataFrame, file: str) -> DataFrame:
    """rows with the column ids replaced by text (null stays null; ids out of the vocabulary are passed over); it comes last."""
    ensure_session(rows.sparkSession)
    others = [c for c in rows.columns if c.lower() not in ("text", "ids")]
    kept = rows.select(*(F.col(f"`{c}`") for c in others), F.col("ids").cast("array<int>").alias("ids"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["text string"])
    return kept.mapInArrow(lean(lambda it: _decode_partition(it, file)), schema)


def digests(docs: DataFrame, file: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, and digests of its ids and of the text decoded from them (see the module's text)."""
    ensure_session(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(lean(lambda it: _digest_partition(it, file)), SCHEMA)
