"""Alignment of tokenizers, whitening and sentence pieces against brute force and small hard cases."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidal.llm import alignment, queries, secrets, sentence_pieces, sharding, units, whitening

DATA = "/root/testdata/sf0.001"
BITS = ["a", "b", " ", "  ", "the", "\n", " \n", "é", "日本", "😀", " ", "ab", "\x00", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "x" * 7, "  " * 5, "\t", "ing", "tion", " format", "'s", "1999", "\xa0", "naïve", "مرحبا", "\x1c", "\x85", "é"]


@functools.cache
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))


def fuzz(n, bits=BITS, longest=40, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(bits) for _ in range(r.randint(0, longest))) for _ in range(n)]


def frame(spark, texts):
    """Texts as documents with columns that clash with those of the operators."""
    rows = [(i, t, 0, "x", [1], [2], 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string, pairs array<int>, times array<int>, row int")


def texts_of_table(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


# sentence pieces

def in_parts(texts, limit):
    encode = sentence_pieces.encoder(queries.tokenizer_file("piece_bpe_32k.model"))
    ids, back = [], []
    for part in units.parts(pa.array(texts, type=pa.string()), limit):
        flat, sizes = encode(part.data, part.offsets)
        if part.begins:
            empty = np.diff(part.offsets) == 1
            flat, sizes = flat[np.repeat(~empty, sizes)], np.where(empty, 0, sizes)
        for one, text in zip(np.split(flat, np.cumsum(sizes)[:-1]), encode.model.decode(flat, sizes, part.begins)):
            if part.begins:
                ids.append([])
                back.append(b"")
            ids[-1] += one.tolist()
            back[-1] += text
    return ids, [t.decode() for t in back]


@pytest.mark.parametrize("limit", [1 << 21, 50])
def test_pieces_equal_the_library(limit):
    pieces = [library().id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = fuzz(3000, [*BITS, "▁"]) + fuzz(3000, pieces, 12) + fuzz(1000, list("etaoinshr"), 60) + fuzz(1000, ["ab", "aba", "a", "aa", "  ", " "], 60) + [" " * 5000, "ab" * 3000, "x y" * 2000]
    want = library().encode(texts)
    ids, back = in_parts(texts, limit)
    assert ids == want and back == library().decode(want)


def test_decoding_of_any_ids():
    r = random.Random(2)
    lists = [[r.choice([1, 2, 0, r.randrange(3, 259), r.randrange(259, 32000), 3 + 0xE2, 3 + 0x96, 3 + 0x81, 28705]) for _ in range(r.randint(0, 12))] for _ in range(4000)]
    model = sentence_pieces.encoder(queries.tokenizer_file("piece_bpe_32k.model")).model
    got = model.decode(np.array([i for x in lists for i in x]), np.array([len(x) for x in lists]))
    assert [g.decode() for g in got] == library().decode(lists)


def test_one_unbroken_unit():
    r = random.Random(3)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(30000))
    assert in_parts([text], 1000)[0] == library().encode([text])


def digests_of(texts):
    out = []
    for t in texts:
        ids = library().encode(t or "", add_eos=True)
        out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library().decode(ids).encode()).hexdigest()))
    return out


def test_op13_against_the_library(spark):
    want = dict(zip(texts_of_table(spark), digests_of(texts_of_table(spark).values())))
    assert {r[0]: tuple(r)[1:] for r in queries.op13_sentence_pieces(spark, DATA).collect()} == want


def test_digests_of_hard_rows(spark):
    texts = [None, "", " ", "a", "a", "▁", "word " * 20000, "\n" * 500]
    docs = frame(spark, texts)
    got = sentence_pieces.digests(docs.unionByName(docs.where("doc_id = 3")), queries.tokenizer_file("piece_bpe_32k.model")).collect()
    assert Counter((r[0], *r[1:]) for r in got) == Counter([*((i, *d) for i, d in enumerate(digests_of(texts))), (3, *digests_of(["a"])[0])])
    assert sentence_pieces.digests(docs.limit(0), queries.tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_encode_and_decode_frames(spark):
    texts = [None, "", "a  b", "日本 <s>", "x"]
    file = queries.tokenizer_file("piece_bpe_32k.model")
    ids = sentence_pieces.encode(frame(spark, texts), file)
    assert {r["doc_id"]: list(r["ids"]) for r in ids.collect()} == {i: library().encode(t or "", add_eos=True) for i, t in enumerate(texts)}
    back = sentence_pieces.decode(ids.withColumn("ids", F.when(F.col("doc_id") != 4, F.col("ids"))), file)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {0: "", 1: "", 2: "a  b", 3: "日本 <s>", 4: None}


def test_models_that_change_texts_are_refused(tmp_path):
    with open(queries.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    for name, more in (("spaces", b"\x1a\x02\x20\x01"), ("unigram", b"\x12\x02\x18\x01"), ("symbol", b"\x0a\x05\x0a\x01q\x18\x04")):
        (tmp_path / name).write_bytes(data + more)
        with pytest.raises(ValueError, match="can be read"):
            sentence_pieces.PieceModel(str(tmp_path / name))


# alignment

@functools.cache
def byte_level():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return tokenizer, table


def aligned(text):
    """Token counts and groups of a text, or None where it has no tokens."""
    (a, table), b = byte_level(), library()
    if not text:
        return None
    raw, ids_a, ids_b = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        m, n = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((ids_a[i:m], ids_b[j:n]))
        i, j = m, n
    return len(ids_a), len(ids_b), groups


def brute(texts):
    found = [aligned(t) for t in texts]
    links = [Counter((x, y) for a, b in d[2] for x in a for y in b) if d else Counter() for d in found]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for d, own in zip(found, links):
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in d[2])
        out.append((d[0], d[1], len(d[2]), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), hashlib.sha256(written.encode()).hexdigest()))
    return out


COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
FILES = (queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.tokenizer_file("piece_bpe_32k.model"))


def test_op11_against_brute_force(spark):
    table = texts_of_table(spark)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, DATA).collect()}
    assert got == dict(zip(table, brute(table.values())))


@pytest.mark.parametrize("hot", [alignment.HOT, 20])
def test_alignment_of_hard_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    texts = [*fuzz(700), *fuzz(60, [*BITS, "▁"], 10, 4), None, "", " ", "a▁b", "▁", "\n" * 4000, "aé" * 800, "the cat " * 400, "the", "the"]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(frame(spark, texts).repartition(3), *FILES).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_repeated_ids_and_an_empty_table_align(spark):
    docs = frame(spark, ["the cat", "the cat"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in alignment.align(docs, *FILES).collect()] == [(None, *brute(["the cat"] * 2)[0])] * 2
    assert alignment.align(docs.limit(0), *FILES).count() == 0


def test_long_texts_align_in_parts(monkeypatch):
    texts = [*fuzz(200, longest=300, seed=7), "a▁b " + "the cat sat " * 60, "the cat sat " * 60 + "a▁b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    whole = list(alignment.align_partition([batch], *FILES))[0].to_pydict()
    monkeypatch.setattr(alignment, "parts", lambda column: units.parts(column, 64))
    assert list(alignment.align_partition([batch], *FILES))[0].to_pydict() == whole
    assert whole["n_a"][-2:] == [0, 0] and whole["pairs"][-1] == []


def test_large_groups_are_summed():
    a, b = np.array([5, 5, 6, 7] * 40), np.array([1, 2, 2] * 30)
    key, times, group = alignment.Aligner._links(a, b, np.array([0]), np.array([0]), np.array([160]), np.array([90]))
    want = Counter((x << alignment.B_BITS | y) for x in a.tolist() for y in b.tolist())
    assert dict(zip(key.tolist(), times.tolist())) == want and set(group.tolist()) == {0}


# whitening

def reference(vectors):
    x = np.floor(256 * np.asarray(vectors, dtype=float)).astype(int)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh((fit - total / n).T @ (fit - total / n) / n)
    k = min(4, x.shape[1])
    values, basis = values[::-1], basis[:, ::-1][:, :k]
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ basis / np.sqrt(values[:k]), values[:k] / values.sum()


def check(rows, vectors, ids):
    n, deviation, whitened, explained = reference(vectors)
    k = whitened.shape[1]
    assert len(rows) == len(ids) * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    sign = np.sign([got[ids[0], c + 1]["whitened"] for c in range(k)]) * np.sign(whitened[0])
    for i, v in enumerate(ids):
        for c in range(k):
            r = got[v, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[i]) and r["whitened"] == pytest.approx(sign[c] * whitened[i, c], abs=1e-9)
            assert r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-9


def test_op12_against_eigenvectors(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    check(queries.op12_whitening(spark, DATA).collect(), np.stack(table["embedding"]), table["vec_id"].tolist())


def test_whitening_of_hard_rows(spark):
    r = np.random.default_rng(1)
    good = r.standard_normal((300, 6)) * [5, 4, 3, 2, 1, 0.5] + 100
    good[200:] = good[0]  # a third are one vector
    bad = [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    rows = [(i, v.tolist() if v is not None and not isinstance(v, list) else v, 7, 0.5) for i, v in enumerate([*good, *bad])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, whitened double").repartition(7)
    check(whitening.whiten(frame).collect(), good, list(range(300)))


def test_whitening_without_variance_or_rows(spark):
    of = lambda rows: [tuple(r) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert of([]) == of([(1, None)]) == of([(1, [])]) == []
    assert of([(1, [1.0]), (None, [1.0])]) == [(1, 1, 1, 0, None, None, None), (None, 1, 1, 0, None, None, None)]
    got = of([(1, [1.0]), (2, [3.0, 0.0])])
    assert [x[:4] + x[5:] for x in got] == [(1, 1, 2, 2 * 256**2 * 2, 1.0, 0.0), (1, 2, 2, 2 * 256**2 * 2, 0.0, 0.0), (2, 1, 2, 2 * 256**2 * 2, 1.0, 0.0), (2, 2, 2, 2 * 256**2 * 2, 0.0, 0.0)]
    assert [x[4] for x in got] == [-1.0, None, 1.0, None]
    far = of([(1, [1e30, 2.0]), (2, [-1e30, 5.0]), (3, [0.5, 0.25])])
    assert [x[3] is None for x in far] == [True, True, True, True, False, False]


def test_triangles_merge_to_one():
    r = np.random.default_rng(2)
    rows = r.standard_normal((500, 5))
    merge = whitening._merge_triangles(5)
    got = np.frombuffer(functools.reduce(merge, [whitening.triangle(x).tobytes() for x in np.split(rows, [3, 3, 100, 450])])).reshape(-1, 5)
    assert np.allclose(got.T @ got, rows.T @ rows)


def test_exact_sums_carry():
    part = np.array([2, 5, -1, 0xFFFFFFFF, 7], dtype=np.int64).tobytes()
    got = np.frombuffer(functools.reduce(whitening._merge_sums, [part] * 9), dtype=np.int64).tolist()
    assert got[0] == 18 and [(h << 32) + low for h, low in zip(got[1:3], got[3:])] == [9 * ((5 << 32) + 0xFFFFFFFF), 9 * ((-1 << 32) + 7)]


# control of discoveries, and sizes of shards

def test_candidates_in_patterns_are_no_discoveries(spark):
    r = random.Random(8)
    hexes = [f"key {hashlib.sha256(bytes([i])).hexdigest()} end" for i in range(60)]
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(3, 8)))
    words = [" ".join("_".join(word() for _ in range(5)) for _ in range(4)) for _ in range(150)]
    tokens = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(44)) for _ in range(3)]
    texts = [*words, *(f"a {t} b" for t in tokens), None, ""]
    frame_of = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alone, beside = (secrets.fit_thresholds(frame_of(t)) for t in (texts, [*texts, *hexes]))
    assert alone == beside
    histogram = Counter((t, b) for x in texts if x for *_, t, b in secrets.scan(x)[1])
    for stratum, least in alone.items():
        bins = [b for (t, b), n in histogram.items() if t == stratum for _ in range(n)]
        fits = [b for b in bins if 10 ** (-b / secrets.STEP) * len(bins) <= 0.01 * sum(x >= b for x in bins)]
        assert least == (min(fits) if fits else secrets.LAST + 1)
    got = {x["doc_id"]: x for x in secrets.find_secrets(frame_of([*texts, *hexes])).collect()}
    for i, text in enumerate([*texts, *hexes]):
        base, more = secrets.scan(text or "")
        spans = sorted([(s, k, e) for s, e, k in base] + [(s, k, e) for s, e, k, t, b in more if b >= alone.get(t, secrets.LAST + 1)])
        assert got[i]["spans"] == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    assert all(got[len(words) + i]["n_random"] == 1 for i in range(3))


def test_redaction_in_place(spark):
    key = hashlib.sha256(b"x").hexdigest()
    rows = [(1, None, None, "m", 0), (2, "", 0, "m", 0), (3, f"é {key} and password={key}", 9, "m", 1), (3, f"é {key} and password={key}", 9, "m", 1), (None, "plain words", 11, "m", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, marks string, row int")
    got = sorted((tuple(r) for r in secrets.redact(docs).collect()), key=str)
    cut = "é [secret] and [secret]"
    assert got == sorted([rows[0], rows[1], (3, cut, len(cut), "m", 1), (3, cut, len(cut), "m", 1), rows[4]], key=str)
    assert secrets.redact(docs.limit(0)).count() == 0 and secrets.redact(docs).schema == docs.schema


def test_shards_are_of_the_target_size(spark, tmp_path):
    rows = spark.range(12000).select("id", F.concat(*(F.sha2(F.concat("id", F.lit(str(i))), 256) for i in range(16))).alias("text"))
    store = sharding.Store(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan_in=4)
    store.append(rows.repartition(48))
    store.compact()
    sizes = sorted(s["bytes"] / (1 << 20) for s in store.manifest()["shards"])
    whole = [x for x in sizes if x >= 0.5]
    assert max(sizes) <= 1.5 and sum(whole) >= 0.9 * sum(sizes) and store.read().count() == 12000


def test_operators_ship_themselves(spark, monkeypatch):
    from tidal import shipping
    from tidal.llm import store

    seen = []
    monkeypatch.setattr(store, "ship", lambda session: seen.append(session) or shipping.ship(session))
    store.lean(iter)
    assert seen
