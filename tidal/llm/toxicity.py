"""Toxicity scores from a weighted finite-state grammar over clauses.

Words are mapped to symbols (insult, threat, target, negation, report, other) with
weights, and every clause is read by a cascade of five small weighted transducers, in
which each reads what the one before it wrote: negation and reported speech rewrite
the weights of the insults and threats in their reach and are used up; threats and
targets are joined to menaces, in either order, the weight waiting in the state until
the other part comes; targets raise the insults after them; insults and menaces are
summed at the end.  So a negated or reported threat counts less wherever its target
stands.  Arcs of insults and of threats are learned: their weights are smoothed
log-odds of a word between toxic and other documents, so that a word which means a
threat in one language and nothing in another weighs what the labels say.  The clause
scores of a document feed a logistic model.

All are fitted on a bounded sample (parameter ``sample``) of doc_ids of the training
folds that have a label and a document, the first by a hash of doc_id; every document
is scored.

Defined results: a null or empty text has no clause and gets the score of a text
without matches; equal rows get equal scores; of rows with one doc_id the least text
is learned from, once; labels of one doc_id that differ count as toxic; unlabelled or
empty tables give scores of a model without evidence (0.5 is never reached); very long
texts are scored whole, clause by clause; ties don't arise, as sums don't depend on
order; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .kernels import Words, chunks
from .store import lean

#: Fixed word lists of the closed symbol classes (English, French, German, Spanish).
TARGET = "you your yours u ur he she they him her them tu toi vous ton votre il elle ils du dich dir ihr euch er sie tú te usted ustedes él ella".split()
NEGATION = "not never no n't isn aren wasn don doesn didn pas ne jamais non nicht kein keine nie nunca ningún tampoco".split()
REPORT = "said says say wrote writes called calls quoted quote according dit disait écrit appelle sagte sagt schrieb nannte dijo dice escribió llamó".split()
THREAT = "kill kills hurt destroy beat shoot stab murder tuer détruire frapper töten schlagen zerstören sterben matar golpear destruir morir".split()
INSULT_, THREAT_, TARGET_, NEGATION_, REPORT_ = range(5)
#: A long distance between two symbols, and a threat with its target.
GAP_, MENACE_ = 5, 6
#: Words between two symbols after which a negation no longer holds.
REACH = 4

CLAUSE_END = np.zeros(256, dtype=bool)
CLAUSE_END[list(b".!?;\n")] = True
_LETTERS = np.ones(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256), ord("'")]] = False


class Transducer:
    """Weighted arcs {(state, symbol): (next state, symbol written or None, factor)}; a missing arc keeps the state and copies the symbol.

    The weight of a symbol written is the product of the weight read, the factor, and
    what waits in the state; a symbol that is held back (None, of INSULT_ or THREAT_)
    leaves its weight there.
    """

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int | None, float]]):
        self.arcs = arcs

    def read(self, tape: Iterable[tuple[int, float]]) -> Iterator[tuple[int, float]]:
        state, waiting = 0, 1.0
        for symbol, weight in tape:
            arc = self.arcs.get((state, symbol))
            if arc is None:
                yield symbol, weight
                continue
            state, written, factor = arc
            if written is None:
                waiting = weight * factor if symbol in (INSULT_, THREAT_) else factor
            else:
                yield written, (weight if symbol != TARGET_ else 1.0) * factor * waiting
                waiting = 1.0


#: state 1: a negation is near; the next insult or threat uses it up, a gap ends it.
NEGATIONS = Transducer({(0, NEGATION_): (1, None, 0.4), (1, NEGATION_): (1, None, 0.4), (1, INSULT_): (0, INSULT_, 1.0), (1, THREAT_): (0, THREAT_, 1.0), (1, GAP_): (0, GAP_, 1.0)})
#: state 1: what follows is reported speech, up to the clause's end.
REPORTS = Transducer({(0, REPORT_): (1, None, 1.0), (1, REPORT_): (1, None, 1.0), (1, INSULT_): (1, INSULT_, 0.6), (1, THREAT_): (1, THREAT_, 0.6)})
#: state 1: a target was named, and stays on the tape; state 2: a threat waits for its target.
MENACES = Transducer({(0, TARGET_): (1, TARGET_, 1.0), (1, THREAT_): (0, MENACE_, 2.0), (0, THREAT_): (2, None, 1.0), (2, TARGET_): (0, MENACE_, 2.0), (2, THREAT_): (2, None, 1.0)})
#: state 1: a target was named or threatened; insults after it weigh more.
TARGETS = Transducer({(0, TARGET_): (1, TARGET_, 1.0), (0, MENACE_): (1, MENACE_, 1.0), (1, INSULT_): (1, INSULT_, 1.5)})
#: state 1: an insult was read; another one in the clause weighs more.
INSULTS = Transducer({(0, INSULT_): (1, INSULT_, 1.0), (1, INSULT_): (1, INSULT_, 1.2)})
GRAMMAR = (NEGATIONS, REPORTS, MENACES, TARGETS, INSULTS)


def read_clause(symbols: Iterable[tuple[int, float]], grammar: tuple[Transducer, ...] = GRAMMAR) -> tuple[float, float]:
    """Insult and threat score of a clause, given as (symbol, weight) in order: the composition of the grammar's transducers reads it."""
    tape = iter(symbols)
    for transducer in grammar:
        tape = transducer.read(tape)
    scores = {INSULT_: 0.0, MENACE_: 0.0}
    for symbol, weight in tape:
        if symbol in scores:
            scores[symbol] += weight
    return scores[INSULT_], scores[MENACE_]


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Lower-cased runs of letters (ASCII, Latin-1 capitals lowered, all other non-ASCII kept)."""
    data = kernels.LOWER[data]
    high = np.flatnonzero(data == 0xC3) + 1
    high = high[high < len(data)]
    b = data[high]
    data[high[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 0x20
    return Words(data, offsets, space=_LETTERS)


def word_hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        raw = np.frombuffer(w.encode(), dtype=np.uint8)
        out.append(_words(raw, np.array([0, len(raw)])).hash[:1])
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _closed() -> tuple[np.ndarray, np.ndarray]:
    hashes, kinds = [], []
    for kind, words in ((THREAT_, THREAT), (TARGET_, TARGET), (NEGATION_, NEGATION), (REPORT_, REPORT)):
        h = word_hashes(words)
        hashes.append(h)
        kinds.append(np.full(len(h), kind))
    return np.concatenate(hashes), np.concatenate(kinds)


def _evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> documents with a word, by word and label."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, data, offsets in chunks(batch.column(0)):
            words = _words(data, offsets)
            pair = np.unique(np.stack([words.hash, words.text_of_word().astype(np.uint64)], axis=1), axis=0) if len(words) else np.empty((0, 2), dtype=np.uint64)
            toxic = label[a:b][pair[:, 1].astype(np.int64)]
            word, at = np.unique(pair[:, 0], return_inverse=True)
            hit = np.bincount(at, weights=toxic, minlength=len(word)).astype(np.int64) if len(word) else np.empty(0, dtype=np.int64)
            every = np.bincount(at, minlength=len(word)) if len(word) else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(hit), pa.array((every - hit).astype(np.int64))], names=["word", "toxic", "clean"])


FEATURES = 6


def features(column: pa.Array, lexicon: np.ndarray, weights: np.ndarray, threats: np.ndarray) -> np.ndarray:
    """threats: the weights of the words of THREAT.  Per text: sum and maximum of clause insult scores, matched clauses, threats, share of matched words, log length."""
    closed, kinds = _closed()
    known = np.concatenate([lexicon, closed])
    symbol = np.concatenate([np.full(len(lexicon), INSULT_), kinds])
    weight = np.concatenate([weights, threats, np.zeros(len(closed) - len(threats))])
    known, first = np.unique(known, return_index=True)
    symbol, weight = symbol[first], weight[first]
    seen = np.zeros(1 << 16, dtype=bool)
    seen[(known >> np.uint64(48)).astype(np.int64)] = True
    out = np.zeros((len(column), FEATURES))
    for a, b, data, offsets in chunks(column):
        words = _words(data, offsets)
        out[a:b, 5] = np.log1p(np.diff(words.first))
        maybe = np.flatnonzero(seen[(words.hash >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(known, words.hash[maybe])
        at[at == len(known)] = 0
        ok = known[at] == words.hash[maybe]
        hit, at = maybe[ok], at[ok]
        strong = symbol[at] <= THREAT_
        if not strong.any():
            continue
        text = words.text_of_word()
        has = np.zeros(b - a, dtype=bool)
        has[text[hit[strong]]] = True
        keep = has[text[hit]]
        hit, at = hit[keep], at[keep]
        clause = np.cumsum(CLAUSE_END[data])[words.start[hit]]
        clauses: dict[tuple[int, int], list] = {}
        before: dict[tuple[int, int], int] = {}
        for i, c, w, k, v in zip(text[hit].tolist(), clause.tolist(), hit.tolist(), symbol[at].tolist(), weight[at].tolist()):
            row = clauses.setdefault((i, c), [])
            if row and w - before[i, c] > REACH:
                row.append((GAP_, 0.0))
            row.append((k, v))
            before[i, c] = w
        for (i, _), symbols in clauses.items():
            insult, threat = read_clause(symbols)
            f = out[a + i]
            f[0] += insult
            f[1] = max(f[1], insult)
            f[2] += insult > 0 or threat > 0
            f[3] += threat
        found = np.bincount(text[hit[symbol[at] == INSULT_]], minlength=b - a)
        out[a:b, 4] = found / np.maximum(1, np.diff(words.first))
    out[:, 0] = np.log1p(out[:, 0])
    out[:, 2] = np.log1p(out[:, 2])
    out[:, 4] = np.log1p(1000 * out[:, 4])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (bias last) of a ridge logistic model, by Newton's method.

    A step is halved until it lowers the loss by a part of what its slope promises: whole
    steps can leave the minimum for good where words all but separate the labels.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))

    def loss(w: np.ndarray) -> float:
        return float((np.logaddexp(0, z @ w) - y * (z @ w)).sum() + penalty * (w[:-1] ** 2).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        g = z.T @ (p - y) + penalty * np.append(w[:-1], 0.0)
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        d = np.linalg.solve(h, g)
        size = 1.0
        while (then := loss(w - size * d)) > now - 1e-4 * size * (g @ d) and size > 1e-9:
            size /= 2
        if then >= now:
            break
        w, now = w - size * d, then
        if np.abs(size * d).max() < 1e-9:
            break
    return mean, scale, w


class Model:
    def __init__(self, lexicon, weights, threats, mean, scale, coefficients):
        self.lexicon, self.weights, self.threats, self.mean, self.scale, self.coefficients = lexicon, weights, threats, mean, scale, coefficients

    def score(self, column: pa.Array) -> np.ndarray:
        z = (features(column, self.lexicon, self.weights, self.threats) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.coefficients[:-1] + self.coefficients[-1], -30, 30)))


def fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def surprise(t: F.Column, c: F.Column, toxic: int, clean: int) -> F.Column:
    """Likelihood ratio statistic of a word in t of the toxic and c of the clean documents against one share in both."""
    every = max(1, toxic + clean)
    n = t + c

    def part(seen: F.Column, expected: F.Column) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    return 2 * (part(t, n * toxic / every) + part(c, n * clean / every) + part(toxic - t, (every - n) * toxic / every) + part(clean - c, (every - n) * clean / every))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: int = 4) -> Model:
    """Grammar weights and model from at most sample labelled doc_ids of the training folds.

    least: toxic documents that a word must occur in to become an insult arc; a threat
    word that occurs in fewer documents keeps the weight 1.  The share of toxic documents
    with an insult is more than twice that of others, and so by more than chance: counts
    are held against shares, as either label may be rare.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").checkpoint()
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
    counted = rows.mapInArrow(lean(_evidence), "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    words = word_hashes(THREAT).view(np.int64).tolist()
    insult = (F.col("t") >= least) & (F.col("w") > math.log(2)) & (surprise(F.col("t"), F.col("c"), toxic, clean) > 15)
    threat = F.col("word").isin(words)
    learned = counted.withColumn("w", odds).where(insult | threat).select("word", "w", (F.col("t") + F.col("c")).alias("n"), (insult & ~threat).alias("insult")).orderBy("word").collect()
    lexicon = np.array([r["word"] for r in learned if r["insult"]], dtype=np.int64).view(np.uint64)
    weights = np.array([r["w"] for r in learned if r["insult"]], dtype=float)
    known = {r["word"]: max(0.0, r["w"]) for r in learned if not r["insult"] and r["n"] >= least}
    threats = np.array([known.get(w, 1.0) for w in words])

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0), lexicon, weights, threats)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in x.T)], names=["toxic", *(f"f{i}" for i in range(FEATURES))])

    table = np.array([tuple(r) for r in rows.mapInArrow(lean(measured), "toxic int, " + ", ".join(f"f{i} double" for i in range(FEATURES))).collect()], dtype=float).reshape(-1, 1 + FEATURES)
    table = table[np.lexsort(table.T[::-1])]
    return Model(lexicon, weights, threats, *fit_logistic(table[:, 1:], table[:, 0]))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Every document's doc_id, held_out, score and predicted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents whose score is below limit, with their columns."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at)) < limit))

    return docs.mapInArrow(lean(run), schema)
