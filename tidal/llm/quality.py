"""Quality rules in DataFrame functions: text statistics and a hashed n-gram likelihood ratio.

Features are a document's words and word pairs, hashed into ``BUCKETS``.  One
multinomial is fitted to trusted documents (labelled of good quality, at most
``trusted`` rows, a documented bound) and one to the whole corpus; the score is
the mean log-likelihood ratio per feature.  Ratios are fixed-point integers, so
sums and thresholding don't depend on the order of rows.

The corpus counts meet in at most BUCKETS rows per task, and the ratios (BUCKETS
rows) are broadcast; documents' features are summed where they are read, so a
document crosses the shuffle as one row of numbers.

Defined results: a null text has no words; texts without words have score null
and fail the base rules; equal rows are scored separately; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SCALE = 1_000_000
#: Pseudo-count of each bucket.
PRIOR = 0.5
SPACES = r"[\x20\x09-\x0D]+"
STRIP = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Maximal runs of non-space."""
    bare = F.btrim(text, F.lit(STRIP))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def _features(hashes: Column, size: Column) -> Column:
    pairs = F.when(size > 1, F.zip_with(F.slice(hashes, 1, F.greatest(size - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")), pairs)


def hashed(docs: DataFrame) -> DataFrame:
    """docs with words, their hashes and n_words."""
    return docs.withColumn("words", words_of(F.coalesce("text", F.lit("")))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words").cast("long"))


def ratios(docs: DataFrame, labels: DataFrame, trusted: int = 20_000) -> DataFrame:
    """(bucket, llr): fixed-point log-likelihood ratio of trusted documents to the corpus, for buckets that occur."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted)
    marked = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("good", F.lit(1))), "doc_id", "left")
    each = hashed(marked).select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(_features(F.col("hashes"), F.col("n_words").cast("int"))).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).checkpoint()
    total = counts.agg(F.sum("raw"), F.sum("target")).first()
    raw, target = (total[0] or 0) + PRIOR * BUCKETS, (total[1] or 0) + PRIOR * BUCKETS
    llr = F.log((F.col("target") + PRIOR) / target) - F.log((F.col("raw") + PRIOR) / raw)
    return counts.select("bucket", F.round(llr * SCALE).cast("long").alias("llr"))


def _repeated(hashes: Column, size: Column) -> Column:
    """Words in 5-word windows found twice or more."""
    at = lambda i, k: F.get(hashes, i + k)
    windows = F.transform(F.sequence(F.lit(0), size - 5), lambda i: F.xxhash64(*(at(i, k) for k in range(5))))
    return F.when(size < 5, F.array().cast("array<bigint>")).otherwise(windows)


def rule_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of every document."""
    base = hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(STRIP)) != "")
    size = F.col("n_words").cast("int")
    first = base.select(
        "doc_id", "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"), _repeated(F.col("hashes"), size).alias("windows"), _features(F.col("hashes"), size).alias("features"),
    )
    # windows that occur twice: sorted with their places, neighbours are compared; most documents have none
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(some, F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    second = first.withColumn("placed", placed)
    before = F.zip_with(F.slice("placed", 1, F.size("placed") - 1), F.slice("placed", 2, F.size("placed") - 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(before, lambda x: x.isNotNull()))))
    third = second.withColumn("starts", F.when(F.col("placed").isNotNull(), starts)).drop("placed", "windows")
    gaps = F.zip_with(F.slice("starts", 1, F.size("starts") - 1), F.slice("starts", 2, F.size("starts") - 1), lambda a, b: F.least(b - a, F.lit(5)))
    covered = F.when(F.col("starts").isNotNull(), F.aggregate(gaps, F.lit(5), lambda acc, x: acc + x)).otherwise(0)
    return third.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), "features",
    )


def judge(docs: DataFrame, labels: DataFrame, threshold: float = -0.22, trusted: int = 20_000) -> DataFrame:
    """Per document: doc_id, the base statistics, base_failed, kept, and llr_mean (null without features).

    threshold: least mean log-likelihood ratio of a kept document.
    """
    table = ratios(docs, labels, trusted)
    rows = rule_columns(docs).withColumn("row", F.monotonically_increasing_id())
    keys = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    each = rows.select(*keys, F.explode_outer("features").alias("bucket")).join(F.broadcast(table), "bucket", "left")
    scored = each.groupBy(*keys).agg(F.sum("llr").alias("sum"), F.count("bucket").alias("n"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    passes = F.col("sum") >= F.lit(round(threshold * SCALE)) * F.col("n")
    return scored.select(*keys[1:], failed.alias("base_failed"), (~failed & F.coalesce(passes, F.lit(False))).alias("kept"), (F.col("sum") / F.when(F.col("n") > 0, F.col("n") * SCALE)).alias("llr_mean"))
