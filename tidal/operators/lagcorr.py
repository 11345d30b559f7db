"""Correlation at sample lags (positions after gaps are removed) and at calendar lags, and discrete correlation functions.

All rest on sums over lags by Fourier transforms of day blocks (see ``blocks``): a row is
copied to the two or three blocks that its lags reach, and sums per block and lag are
partially aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pearson
from .blocks import Term, lagged_sums
from .series import indexed, moments_joined, standardised, transformed, with_day



def sample_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], lo: int, hi: int) -> DataFrame:
    """(keys, lag_days, coefficient): sum x[i + lag] y[i] / sqrt(sum x^2 sum y^2) over positions i; no mean is taken off.

    a and b (keys, i, value) have the same positions.
    """
    square = F.sum(F.col("value") * F.col("value"))
    sums = lagged_sums(a, b, keys, lo, hi, {"pairs": Term("1", "1"), "xy": Term("x", "y", "pairs")}, at="i")
    joined = moments_joined(moments_joined(sums, a, keys, {"xx": square}), b, keys, {"yy": square})
    return joined.select(*keys, F.col("lag").alias("lag_days"), F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("coefficient"))


def sample_autocorrelation(rows: DataFrame, keys: Sequence[str], lo: int, hi: int) -> DataFrame:
    placed = indexed(rows.where("value IS NOT NULL"), keys)
    return sample_correlation(placed, placed, keys, lo, hi)


def pair_terms() -> dict[str, Term]:
    """Sums of x, y and their squares and product over all pairs, and of their logarithms over pairs of positive values."""
    px, py = ("CASE WHEN {0} > 0 THEN 1 ELSE 0 END".format(c) for c in "xy")
    u, v = ("CASE WHEN {0} > 0 THEN log10({0}) ELSE 0 END".format(c) for c in "xy")
    uu, vv = ("CASE WHEN {0} > 0 THEN log10({0}) * log10({0}) ELSE 0 END".format(c) for c in "xy")
    plain = {"n": Term("1", "1"), "sx": Term("x", "1", "n"), "sy": Term("1", "y", "n"), "sxx": Term("x * x", "1", "n"), "syy": Term("1", "y * y", "n"), "sxy": Term("x", "y", "n")}
    return plain | {"m": Term(px, py), "su": Term(u, py, "m"), "sv": Term(px, v, "m"), "suu": Term(uu, py, "m"), "svv": Term(px, vv, "m"), "suv": Term(u, v, "m")}


def pair_statistics(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """pairs, cosine_raw, pearson_raw, pearson_log10, log_pairs of the sums of pair_terms."""
    c = F.col
    return sums.select(
        *by, c("n").alias("pairs"), F.try_divide(c("sxy"), F.sqrt(c("sxx") * c("syy"))).alias("cosine_raw"),
        pearson(c("n"), c("sx"), c("sy"), c("sxx"), c("syy"), c("sxy")).alias("pearson_raw"),
        pearson(c("m"), c("su"), c("sv"), c("suu"), c("svv"), c("suv")).alias("pearson_log10"), c("m").alias("log_pairs"),
    )


def calendar_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], lo: int, hi: int, step: int = 1) -> DataFrame:
    """Pair statistics at each calendar lag that has a pair, every step-th one from lo; +L holds a at t + L against b at t."""
    sums = lagged_sums(with_day(a.where("value IS NOT NULL")), with_day(b.where("value IS NOT NULL")), keys, lo, hi, pair_terms())
    return pair_statistics(sums.where((F.col("lag") - lo) % step == 0) if step > 1 else sums, [*keys, "lag"]).withColumnRenamed("lag", "lag_calendar_days")


def calendar_autocorrelation(rows: DataFrame, keys: Sequence[str], lo: int = 1, hi: int = 2500, step: int = 1) -> DataFrame:
    return calendar_correlation(rows, rows, keys, lo, hi, step)


def _error(n: Column, s: Column, q: Column) -> Column:
    """Standard error of a mean from count, sum and sum of squares; null for fewer than two."""
    return F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)) / n))


def discrete_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], lo: int = 1, hi: int = 600, transform: str = "log10") -> DataFrame:
    """(keys, lag_calendar_days, pairs, dcf, stderr, sum_udcf, sum_sq_udcf): mean product of globally standardised values.

    Lags without pairs are kept with 0 pairs and null dcf.
    """
    za, zb = (with_day(standardised(transformed(x, transform), keys)) for x in (a, b))
    return dcf_of_standardised(za, zb, keys, lo, hi)


def dcf_of_standardised(za: DataFrame, zb: DataFrame, keys: Sequence[str], lo: int, hi: int) -> DataFrame:
    sums = lagged_sums(za, zb, keys, lo, hi, {"pairs": Term("1", "1"), "sum_udcf": Term("x", "y", "pairs"), "sum_sq_udcf": Term("x * x", "y * y", "pairs")})
    lags = F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("lag")
    every = za.select(*keys).distinct().select(*keys, lags) if keys else za.sparkSession.range(1).select(lags)
    n = F.coalesce("pairs", F.lit(0))
    return every.join(sums, [*keys, "lag"], "left").select(
        *keys, F.col("lag").cast("long").alias("lag_calendar_days"), n.alias("pairs"), F.try_divide(F.col("sum_udcf"), F.col("pairs")).alias("dcf"),
        _error(F.col("pairs"), F.col("sum_udcf"), F.col("sum_sq_udcf")).alias("stderr"), F.coalesce("sum_udcf", F.lit(0.0)).alias("sum_udcf"), F.coalesce("sum_sq_udcf", F.lit(0.0)).alias("sum_sq_udcf"),
    )


def binned(dcf: DataFrame, keys: Sequence[str], width: int = 10, origin: int = 0) -> DataFrame:
    """Sums of a DCF pooled into bins of width days from origin; bins without pairs have null dcf."""
    b = F.floor((F.col("lag_calendar_days") - origin) / width).cast("long")
    pooled = dcf.groupBy(*keys, b.alias("b")).agg(F.sum("pairs").alias("pairs"), F.sum("sum_udcf").alias("s"), F.sum("sum_sq_udcf").alias("q"))
    start = F.lit(origin) + F.col("b") * width
    return pooled.select(
        *keys, start.cast("long").alias("lag_bin_start"), (start + width - 1).cast("long").alias("lag_bin_end"), (start + (width - 1) / 2.0).alias("lag_bin_center"), "pairs",
        F.try_divide(F.col("s"), F.col("pairs")).alias("dcf"), _error(F.col("pairs"), F.col("s"), F.col("q")).alias("stderr"),
    )


def binned_means(dcf: DataFrame, keys: Sequence[str], width: int = 10, origin: int = 0) -> DataFrame:
    """Pair-weighted mean of lag values per bin, for a DCF without sums of squares."""
    b = F.floor((F.col("lag_calendar_days") - origin) / width).cast("long")
    live = dcf.where("pairs > 0 AND dcf IS NOT NULL")
    pooled = live.groupBy(*keys, b.alias("b")).agg(F.sum("pairs").alias("pairs"), F.sum(F.col("dcf") * F.col("pairs")).alias("s"))
    start = F.lit(origin) + F.col("b") * width
    return pooled.select(*keys, start.cast("long").alias("lag_bin_start"), (start + width - 1).cast("long").alias("lag_bin_end"), (start + (width - 1) / 2.0).alias("lag_bin_center"), "pairs", F.try_divide(F.col("s"), F.col("pairs")).alias("dcf"))


def index_shifted(common: DataFrame) -> DataFrame:
    """Rows (date, a, b, delay_days) with shifted, b taken delay positions earlier, and its position source (-1: none).

    0 and -1 where that position is outside the record, a is 0 or null, b there is null, or the delay is null.
    """
    placed = indexed(common).withColumn("j", F.col("i") - F.col("delay_days"))
    source = placed.select(F.col("i").alias("j"), F.col("b").alias("moved"))
    ok = F.col("moved").isNotNull() & (F.col("a") != 0)
    joined = placed.join(source, "j", "left")
    return joined.select("date", "a", "b", "delay_days", F.when(ok, F.col("moved")).otherwise(0.0).alias("shifted"), F.when(ok, F.col("j")).otherwise(-1).cast("long").alias("source"))
