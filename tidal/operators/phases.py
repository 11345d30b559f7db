"""Phases as jobs over all channels at once: screening, tests of locked candidates, and an atlas of evidence.

Rows are (channel, side, date, value) of two sides 'a' and 'b'; values are taken as log10
where positive.  A candidate list is fixed before its tests run: rows (channel, band, role)
with one band for all.  Statuses are carried: a test that can't be made has null p-values
and doesn't count in its family.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import concordance
from . import nulls
from .lagcorr import binned, discrete_correlation
from .multiplicity import adjusted
from .peaks import band_maximum, lag_morphology, nearest_window_peak, spectrum_morphology, top_peaks
from .series import detrended, in_windows, transformed, with_day
from .spectra import lomb_scargle_log, sampling_window

#: Names of the variants, and how values are detrended.
VARIANTS = {"raw": "none", "detrended": "linear"}
Bands = dict[str, tuple[int, int]]


def _each_variant(make) -> DataFrame:
    return reduce(DataFrame.unionByName, (make(d).withColumn("variant", F.lit(v)) for v, d in VARIANTS.items()))


def variants(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, variant, date, value): logarithms as they are, and about each key's line."""
    logs = with_day(transformed(rows, "log10"))
    return _each_variant(lambda d: detrended(logs, keys, d).select(*keys, "date", "value"))


def locked_spectral(rows: DataFrame, candidates: DataFrame, band: tuple[float, float], simulations: int = 1999, periods: int = 96, seed: int = 1998) -> DataFrame:
    """Red-noise tests of the largest power in the band for both sides of every candidate, adjusted over all of them within a variant.

    (channel, band, role, side, variant, status, observed, observed_at, p_value, p_holm, q_bh, exceedances, used, null_q95, null_q99)
    """
    keys = ["channel", "side"]
    live = transformed(rows, "log10").join(candidates.select("channel"), "channel", "left_semi")
    tests = _each_variant(lambda d: nulls.ar1_spectral_null(live, keys, band, simulations, d, periods, seed))
    frame = candidates.select("channel", F.col("band").alias("of_band"), "role", F.explode(F.array(*map(F.lit, "ab"))).alias("side")).withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    got = frame.join(tests.drop("band"), [*keys, "variant"], "left").withColumn("status", F.coalesce("status", F.lit("insufficient_data"))).withColumnRenamed("of_band", "band")
    return adjusted(got, ["band", "variant"], "p_value", order=keys)


def locked_joint(rows: DataFrame, candidates: DataFrame, band: tuple[float, float], simulations: int = 1999, periods: int = 96, years: int = 8, step: int = 2, least: int = 180, seed: int = 1998) -> DataFrame:
    """Tests of the largest power at one period in one window for each side and for both together, of every candidate.

    The joint tests of all candidates are adjusted within a variant; those of one side aren't
    part of the family.  (channel, band, role, variant, statistic, status, observed, observed_at,
    window_start, window_stop, p_value, p_holm, q_bh, exceedances, used, null_q95, null_q99)
    """
    live = transformed(rows, "log10").join(candidates.select("channel"), "channel", "left_semi")
    tests = _each_variant(lambda d: nulls.joint_null(live, ["channel"], band, simulations, d, periods, years, step, least, seed))
    frame = candidates.select("channel", F.col("band").alias("of_band"), "role", F.explode(F.array(*map(F.lit, ("a", "b", "joint")))).alias("statistic")).withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    got = frame.join(tests.withColumnRenamed("band", "statistic"), ["channel", "variant", "statistic"], "left").withColumn("status", F.coalesce("status", F.lit("insufficient_data"))).withColumnRenamed("of_band", "band")
    in_family = F.when(F.col("statistic") == "joint", F.col("p_value"))
    return adjusted(got.withColumn("_family", in_family), ["band", "variant"], "_family", order=["channel"]).drop("_family")


def profiles(rows: DataFrame, keys: Sequence[str], lo: int, hi: int, width: int) -> DataFrame:
    """Binned DCFs (keys, branch, bins) of rows (keys, side, date, value): of each side with itself and of a against b, as they are."""
    own = binned(discrete_correlation(rows, rows, [*keys, "side"], lo, hi, "raw"), [*keys, "side"], width, lo).withColumn("branch", F.concat(F.lit("acf_"), "side")).drop("side")
    a, b = (rows.where(F.col("side") == s).drop("side") for s in "ab")
    cross = binned(discrete_correlation(a, b, keys, lo, hi, "raw"), keys, width, lo).withColumn("branch", F.lit("ccf"))
    return own.unionByName(cross)


def screening(rows: DataFrame, bands: Bands, lo: int = 250, hi: int = 600, width: int = 10, frequencies: int = 3500, least_pairs: int = 100) -> DataFrame:
    """One row per channel and band: values of both sides, best bins of three DCFs, spectral and window peaks of both sides and their distance, the largest of
    the three coefficients, and the rank by it within the band."""
    keys, both = ["channel"], ["channel", "side"]
    logs = transformed(rows, "log10").select(*both, "date", "value")
    dcf = band_maximum(profiles(logs, keys, lo, hi, width), [*keys, "branch"], "lag_bin_center", "dcf", bands, least_pairs)
    dcf = dcf.groupBy(*keys, "band").agg(*(F.max(F.when(F.col("branch") == b, F.col(c))).alias(f"{n}_{b}") for b in ("acf_a", "acf_b", "ccf") for c, n in (("lag_bin_center", "lag"), ("dcf", "dcf"))))
    peaks = [band_maximum(x, both, "period_days", "power", bands).select(*both, "band", F.struct("period_days", "power").alias(n)) for x, n in ((lomb_scargle_log(rows, both, lo, hi, frequencies), "gls"), (sampling_window(rows, both, lo, hi), "window"))]
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    columns = {f"{n}_{p}_{s}": of(s, f"{n}.{c}") for s in "ab" for n, c, p in (("gls", "period_days", "period"), ("gls", "power", "power"), ("window", "period_days", "period"))}
    spectra = peaks[0].join(peaks[1], [*both, "band"], "full").groupBy(*keys, "band").agg(*(c.alias(n) for n, c in columns.items()))
    counts = rows.groupBy("channel").agg(*(F.count(F.when(F.col("side") == s, F.col("value"))).alias(f"n_{s}") for s in "ab"))
    frame = counts.withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    got = frame.join(dcf, [*keys, "band"], "left").join(spectra, [*keys, "band"], "left")
    got = got.withColumns({f"gls_minus_window_{s}": F.col(f"gls_period_{s}") - F.col(f"window_period_{s}") for s in "ab"} | {"screen_score": F.greatest("dcf_acf_a", "dcf_acf_b", "dcf_ccf")})
    return got.withColumn("rank", F.expr("row_number() OVER (PARTITION BY band ORDER BY screen_score DESC NULLS LAST, channel)"))


def atlas(rows: DataFrame, bands: Bands, tests: DataFrame, lo: int = 200, hi: int = 700, width: int = 10, frequencies: int = 3000, least_pairs: int = 100, limited_before: str | None = None) -> DataFrame:
    """Evidence beside each other per channel, band and variant, without a score.

    On each side's own span: lag and spectral peaks with their morphology, the nearest peak
    of the sampling window, and the p-values of earlier tests (channel, band, variant, branch,
    p, p_holm, q_bh), looked up by branch acf_a and acf_b.  On the common span: both periods,
    whether they agree within a tenth, both are local peaks, and either lies within one resolution
    unit of the sampling window.  limited_before: side b is quality limited if it ends before that date.
    """
    both = ["channel", "side"]
    live = rows.where("value > 0").select(*both, "date", "value")
    shared = nulls.sides_in_span(live, ["channel"])
    spans = live.withColumn("span", F.lit("own")).unionByName(shared.select(*both, "date", "value").withColumn("span", F.lit("common")))
    by = [*both, "span"]
    logs = variants(spans, by)
    own = logs.where("span = 'own'")
    lag = lag_morphology(binned(discrete_correlation(own, own, [*both, "variant"], lo, hi, "raw"), [*both, "variant"], width, lo), [*both, "variant"], bands, least_pairs)
    signal = _each_variant(lambda d: spectrum_morphology(lomb_scargle_log(spans, by, lo, hi, frequencies, d), by, bands))
    limits = live.groupBy(*both).agg(F.min("date").alias("first"), F.max("date").alias("last")).withColumn("span", F.lit("own"))
    limits = limits.unionByName(shared.select(*both, F.col("_first").alias("first"), F.col("_last").alias("last")).distinct().withColumn("span", F.lit("common")))
    window = top_peaks(sampling_window(spans, by, lo, hi, positive=True, limits=limits), by, "period_days", "power", 12, [F.desc("prominence"), F.desc("power"), F.asc("period_days")])
    days = limits.select(*by, (F.datediff("last", "first") + 1).alias("span_days"))
    near = nearest_window_peak(signal.join(days, by), window.select(*by, "period_days", "power", "prominence"), by)
    at = ["channel", "band", "variant"]
    of = lambda s, c, span: F.max(F.when((F.col("side") == s) & (F.col("span") == span), F.col(c)))
    wanted = {"ls_period": "period_days", "ls_local_peak": "is_local_peak", "ls_band_edge": "at_band_edge", "window_period": "nearest_window_period_days", "window_separation": "frequency_separation_rayleigh", "alias_warning": "within_one_rayleigh"}
    spectral = near.groupBy(*at).agg(*(of(s, c, "own").alias(f"{n}_{s}") for s in "ab" for n, c in wanted.items()), *(of(s, c, "common").alias(f"_{n}_{s}") for s in "ab" for n, c in wanted.items()))
    lags = {"acf_lag": "lag_bin_center", "acf_dcf": "dcf", "acf_local_peak": "is_local_peak", "acf_band_edge": "at_band_edge"}
    lagged = lag.groupBy(*at).agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{n}_{s}") for s in "ab" for n, c in lags.items()))
    prior = tests.where("branch IN ('acf_a', 'acf_b')").groupBy(*at).agg(*(F.max(F.when(F.col("branch") == f"acf_{s}", F.col(c))).alias(f"{c}_{s}") for s in "ab" for c in ("p", "p_holm", "q_bh")))
    quality = limits.where("span = 'own' AND side = 'b'").select("channel", F.coalesce(F.col("last") < F.lit(limited_before).cast("date"), F.lit(False)).alias("quality_limited"))
    gap, _, close = concordance(F.col("_ls_period_a"), F.col("_ls_period_b"))
    either = lambda c: F.coalesce(F.col(f"_{c}_a"), F.lit(False)) | F.coalesce(F.col(f"_{c}_b"), F.lit(False))
    flags: dict[str, Column] = {
        "common_period_difference": gap, "common_within_10_percent": close, "either_common_alias_warning": either("alias_warning"), "either_common_band_edge": either("ls_band_edge"),
        "both_common_local_peaks": F.coalesce(F.col("_ls_local_peak_a") & F.col("_ls_local_peak_b"), F.lit(False)),
    }
    got = spectral.join(lagged, at, "left").join(prior, at, "left").join(quality, "channel", "left").withColumns(flags)
    return got.drop(*(f"_{n}_{s}" for n in wanted for s in "ab"))


def localised(rows: DataFrame, candidates: DataFrame, windows: DataFrame, bands: Bands, lo: int = 250, hi: int = 600, width: int = 10, least_pairs: int = 30) -> DataFrame:
    """(channel, band, branch, window_start, lag_bin_center, dcf, pairs): best bins of three DCFs in each window (window_start, window_stop), standardised within it,
    for the channels and bands of candidates only."""
    named = candidates.select("channel", "band").dropDuplicates()
    logs = transformed(rows, "log10").join(named.select("channel").dropDuplicates(), "channel", "left_semi")
    placed = in_windows(logs, windows).select("channel", "window_start", "side", "date", "value")
    keys = ["channel", "window_start"]
    best = band_maximum(profiles(placed, keys, lo, hi, width), [*keys, "branch"], "lag_bin_center", "dcf", bands, least_pairs, others=["pairs"])
    return best.join(named, ["channel", "band"], "left_semi")
