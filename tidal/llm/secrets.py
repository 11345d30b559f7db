"""Secret scan: fixed patterns plus a randomness test battery.

Candidates are runs of 20 or more characters of common text encodings.  For each
one the encoding is inferred (hex, base32, lower-case base36, base64) and three
statistics are held against what word-like tokens of that length would give: a
chi-squared of alphabet uniformity, the number of character-class runs, and the
lag-1 serial correlation.  The three p-values are combined by Fisher's method.
Benjamini-Hochberg thresholds are then set per length class over the candidates
of all documents, from a histogram of bounded size, and candidates that pass
and lie in no pattern span are reported as kind ``random``.

Defined results: a null or empty text has no spans; equal rows are scanned
separately; an empty table gives an empty result; very long texts are scanned whole;
p-values that tie share a bin and are reported together; extra columns are ignored.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, chunks
from .store import ensure_session, lean

#: Fixed patterns and least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SIGNS, HUMP = re.compile(r"[+/_=-]+"), re.compile(r"(?:(?<=[a-z])|(?<![A-Za-z]))[A-Z](?=[a-z]{2})")
KINDS = ("assign", "access", "hex", "random")

ENCODINGS = [("hex", re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z"), 16), ("base32", re.compile(r"[A-Z2-7]+=*\Z"), 32), ("base36", re.compile(r"[a-z0-9]+\Z"), 36), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 64)]
#: Least length of each length class.
LENGTHS = (20, 24, 32, 48, 80)
#: Histogram bins of -log10 p: this many a unit, up to the largest.
STEP, LAST = 20, 800
#: Chance that neighbouring characters of a word-like token differ in class, and its serial correlation.
CLASS_CHANGE, CORRELATION, SQUARES = 0.12, 0.35, 0.0655
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<s:int,e:int,k:int>>, more array<struct<s:int,e:int,k:int,stratum:int,bin:int>>"


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _binomial_tail(n: int, p: float, at_least: int) -> float:
    """P(Bin(n, p) >= at_least), summed from the largest term down."""
    if at_least <= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(at_least + 1) - math.lgamma(n - at_least + 1) + at_least * math.log(p) + (n - at_least) * math.log1p(-p))
    total, k = term, at_least
    while k < n and term > total * 1e-12:
        term *= (n - k) / (k + 1) * p / (1 - p)
        total, k = total + term, k + 1
    return min(1.0, total)


def classify(token: str) -> tuple[str, int]:
    for name, form, size in ENCODINGS:
        if form.match(token):
            return name, size
    return "base64", 64


def battery(token: str) -> float:
    """p-value of the token under the word-like null; small for tokens that look uniformly random.

    Signs between words and capitals that begin a word are how names are written, so
    that the tests are of the token without signs, with such capitals lowered.
    """
    _, m = classify(token)
    token = HUMP.sub(lambda x: x.group().lower(), SIGNS.sub("", token)) or token
    n = len(token)
    counts: dict[str, int] = {}
    for c in token:
        counts[c] = counts.get(c, 0) + 1
    chi = sum(x * x for x in counts.values()) * m / n - n
    excess = n * (m * max(SQUARES, 2 / m) - 1)
    p_chi = _normal((chi - (m - 1 + excess)) / math.sqrt(2 * (m - 1 + 2 * excess)))
    kind = [0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in token]
    p_runs = _binomial_tail(n - 1, CLASS_CHANGE, sum(a != b for a, b in zip(kind, kind[1:])))
    code = [ord(c) for c in token]
    mean = sum(code) / n
    var = sum((c - mean) ** 2 for c in code)
    r = sum((a - mean) * (b - mean) for a, b in zip(code, code[1:])) / var if var else 1.0
    z, at = abs(r) * math.sqrt(n), CORRELATION * math.sqrt(n)
    p_serial = max(_normal(z - at) - _normal(-z - at), 1e-300)
    x = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return min(1.0, math.exp(-x) * (1 + x + x * x / 2))


KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_LOWER_HEX, _COMMON = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LOWER_HEX[list(b"0123456789abcdef")] = True
_COMMON[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-")] = True


def _long_runs(mask: np.ndarray, length: int, cut: np.ndarray) -> np.ndarray:
    """Starts of runs of at least length set entries; a run ends where the next text begins."""
    opens, closes = mask.copy(), mask.copy()
    opens[1:] &= ~mask[:-1] | cut[1:-1]
    closes[:-1] &= ~mask[1:] | cut[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start[end - start >= length]


def suspects(column: pa.Array) -> np.ndarray:
    """Texts in which a pattern can match; a quick look at the bytes that drops none."""
    out = np.zeros(len(column), dtype=bool)
    for a, b, data, offsets in chunks(column):
        low = LOWER[data].tobytes()
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        places = [_long_runs(_LOWER_HEX[data], 16, cut), _long_runs(_COMMON[data], 20, cut)]
        for word in (*KEYWORDS, b"akia"):
            at, found = low.find(word), []
            while at >= 0:
                found.append(at)
                at = low.find(word, at + 1)
            places.append(np.array(found, dtype=np.int64))
        out[a + np.searchsorted(offsets, np.concatenate(places), side="right") - 1] = True
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int]]]:
    """Pattern spans (start, end, kind number) in order, and candidates outside of them with length class and p bin."""
    base = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base.sort(key=lambda x: (x[0], x[2]))
    more, upto, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while upto < len(base) and base[upto][0] <= m.start():
            reach, upto = max(reach, base[upto][1]), upto + 1
        if m.end() <= reach:
            continue
        token = m.group()
        stratum = sum(len(token) >= x for x in LENGTHS) - 1
        more.append((m.start(), m.end(), 3, stratum, min(LAST, int(-math.log10(max(battery(token), 1e-300)) * STEP))))
    return base, more


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    triple = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32())]))
    five = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32())]))
    for batch in batches:
        sha, bases, mores, counts = [], [], [], ([], [], [])
        for text, suspect in zip(batch.column(1), suspects(batch.column(1)).tolist()):
            base, more = scan(text.as_py() or "") if suspect else ([], [])
            sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            bases.append([{"s": s, "e": e, "k": k} for s, e, k in base])
            mores.append([{"s": s, "e": e, "k": k, "stratum": t, "bin": b} for s, e, k, t, b in more])
            for kind, c in enumerate(counts):
                c.append(sum(x[2] == kind for x in base))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=pa.int64()) for c in counts), pa.array(sha, type=pa.string()), pa.array(bases, type=triple), pa.array(mores, type=five)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "more"])


def thresholds(histogram: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg per length class: the least bin of -log10 p that is reported."""
    out = {}
    for stratum in {h[0] for h in histogram}:
        bins = sorted(((b, n) for s, b, n in histogram if s == stratum), reverse=True)
        total, seen, least = sum(n for _, n in bins), 0, LAST + 1
        for b, n in bins:
            seen += n
            if 10 ** (-b / STEP) * total <= rate * seen:
                least = b
        out[stratum] = least
    return out


def _bin_counts(candidates: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    counts = Counter(candidates)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], type=pa.int32()), pa.array([k[1] for k in counts], type=pa.int32()), pa.array(list(counts.values()), type=pa.int64())], names=["stratum", "bin", "n"])


def fit_thresholds(docs: DataFrame, rate: float = 0.01) -> dict[int, int]:
    """The thresholds of all documents' candidates outside of pattern spans; a task sends its counts only, at most 5 x 801 rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _bin_counts((t, b) for batch in batches for text, suspect in zip(batch.column(0), suspects(batch.column(0)).tolist()) if suspect for *_, t, b in scan(text.as_py())[1])

    ensure_session(docs.sparkSession)
    counts = docs.select("text").mapInArrow(lean(run), "stratum int, bin int, n long").groupBy("stratum", "bin").agg(F.sum("n")).collect()
    return thresholds([tuple(r) for r in counts], rate)


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """One row per document: doc_id, counts and digest of pattern spans, spans as array and as text.

    rate: expected share of word-like tokens among reported random spans of a length
    class.  Candidates inside a pattern span are neither reported again nor counted as
    discoveries.  Only the histogram (at most 5 x 801 rows) comes to the driver.
    """
    ensure_session(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_scan_batches), SCHEMA).checkpoint()
    histogram = found.select(F.explode("more").alias("m")).groupBy("m.stratum", "m.bin").count().collect()
    least = thresholds([tuple(r) for r in histogram], rate)

    def reported(m):
        ok = F.lit(False)
        for stratum, at in sorted(least.items()):
            ok = ok | ((m["stratum"] == stratum) & (m["bin"] >= at))
        return ok

    plain = F.transform(F.filter("more", reported), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["k"].alias("k")))
    every = F.sort_array(F.transform(F.concat("base", plain), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    names = F.array(*map(F.lit, KINDS))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",").alias("spans"),
        F.size(plain).cast("long").alias("n_random"),
        every.alias("span_list"),
    )


def redacted(text: str, least: dict[int, int], mark: str) -> str:
    """The text with each reported span replaced by mark; spans that overlap are replaced as one."""
    base, more = scan(text)
    spans = sorted([(s, k, e) for s, e, k in base] + [(s, k, e) for s, e, k, stratum, b in more if b >= least.get(stratum, LAST + 1)])
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = 0.01) -> DataFrame:
    """Documents with every reported span replaced by mark; other columns stay, n_chars follows the text where that changes.

    One pass counts candidates, a second one replaces spans in place, so that no text is
    shuffled.  Spans that overlap are replaced as one; a null text stays null; equal rows get
    equal results.
    """
    least, columns = fit_thresholds(docs, rate), docs.columns
    text, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            changed = {}
            for i in np.flatnonzero(suspects(batch.column(text))).tolist():
                old = batch.column(text)[i].as_py()
                new = redacted(old, least, mark)
                if new != old:
                    changed[i] = new
            if changed:
                at = pa.array([i in changed for i in range(batch.num_rows)])
                arrays[text] = pc.replace_with_mask(batch.column(text), at, pa.array(list(changed.values()), type=batch.column(text).type))
                if chars is not None:
                    arrays[chars] = pc.replace_with_mask(batch.column(chars), at, pa.array([len(x) for x in changed.values()], type=batch.column(chars).type))
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)
