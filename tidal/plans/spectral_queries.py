"""Queries of spectra, sampling windows, their peaks and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import peaks, series, spectra, waves
from ..operators.waves import Windows
from . import inputs
from .inputs import BANDS, with_
from .lag_queries import bands_sql, calendar, prominence_sql
from .lag_queries import _windows_sql as windows_sql
from .registry import query, tidy
from .series_queries import runs_sql

LO, HI, N = 200, 700, 6000
PI2 = "6.283185307179586"


def _freqs(lo: float, hi: float, n: int) -> str:
    a, b = 1.0 / hi, 1.0 / lo
    return f"(SELECT {a!r}::DOUBLE + k * {(b - a) / (n - 1)!r}::DOUBLE AS f FROM (SELECT unnest(generate_series(0, {n - 1})) AS k))"


def _periods(lo: float, hi: float, n: int) -> str:
    return f"(SELECT 1.0 / ({float(lo)!r}::DOUBLE + k * {(hi - lo) / (n - 1)!r}::DOUBLE) AS f FROM (SELECT unnest(generate_series(0, {n - 1})) AS k))"


def prepared_sql(src: str, keys: str = "", detrend: str = "linear", log10: bool = False, name: str = "LS0") -> str:
    """CTE name: keys, t, y about the mean, less the line if asked."""
    k = f"{keys}, " if keys else ""
    w = f"(PARTITION BY {keys})" if keys else "()"
    y, where = ("log10(value)", "value > 0") if log10 else ("value", "value IS NOT NULL")
    base = f", {name}a AS (SELECT {k}CAST(date_diff('day', min(date) OVER {w}, date) AS DOUBLE) AS t, {y} AS y FROM {src} WHERE {where}), {name}b AS (SELECT {k}t, t - avg(t) OVER {w} AS tc, y - avg(y) OVER {w} AS y, count(*) OVER {w} AS m FROM {name}a)"
    line = f"CASE WHEN m > 2 THEN coalesce(sum(y * tc) OVER {w} / nullif(sum(tc * tc) OVER {w}, 0), 0) * tc ELSE 0 END" if detrend == "linear" else "0"
    return base + f", {name} AS (SELECT {k}t, y - {line} AS y FROM {name}b)"


def lomb_sql(grid: str, keys: str = "", floating: bool = False, least: int = 10, src: str = "LS0", name: str = "LS") -> str:
    k = f"{keys}, " if keys else ""
    cov = lambda ab, a, b: f"({ab} - {a} * {b} / n)" if floating else ab
    yy, cc, ss, cs, yc, ys = cov("yy", "y1", "y1"), cov("cc", "c1", "c1"), cov("ss", "s1", "s1"), cov("cs", "c1", "s1"), cov("yc", "y1", "c1"), cov("ys", "y1", "s1")
    return (
        f", {name}w AS (SELECT {k}f, y, cos({PI2} * f * t) AS c, sin({PI2} * f * t) AS s FROM {src}, {grid}),"
        f" {name}s AS (SELECT {k}f, count(*) AS n, sum(y) AS y1, sum(y * y) AS yy, sum(c) AS c1, sum(s) AS s1, sum(c * c) AS cc, sum(s * s) AS ss, sum(c * s) AS cs, sum(y * c) AS yc, sum(y * s) AS ys FROM {name}w GROUP BY ALL),"
        f" {name}p AS (SELECT {k}1 / f AS period_days, ({ss} * {yc} * {yc} + {cc} * {ys} * {ys} - 2 * {cs} * {yc} * {ys}) / nullif({yy} * ({cc} * {ss} - {cs} * {cs}), 0) AS power FROM {name}s WHERE n >= {least}),"
        f" {name} AS (SELECT * FROM {name}p WHERE power IS NOT NULL AND NOT isnan(power))"
    )


_RESULT = " SELECT round(period_days, 7) AS period_days, round(power, 7) AS power FROM LS"
_A = with_("O", "A")


@query(_A + prepared_sql("A") + lomb_sql(_freqs(20, 2000, 10_000)) + _RESULT)
def lomb_scargle_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(spectra.lomb_scargle_series(inputs.pair(spark, sf_dir)[0], [], 20, 2000, 10_000))


@query(_A + prepared_sql("A", log10=True) + lomb_sql(_freqs(LO, HI, N), floating=True) + _RESULT)
def lomb_scargle_floating_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(spectra.lomb_scargle_log(inputs.pair(spark, sf_dir)[0], [], LO, HI, N))


@query(with_("O") + prepared_sql("O", "channel", "none", log10=True) + lomb_sql(_periods(430, 520, 96), "channel", least=30) + " SELECT channel, round(period_days, 7) AS period_days, round(power, 7) AS power FROM LS")
def lomb_scargle_period_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(spectra.lomb_scargle_periods(inputs.orders(spark, sf_dir), ["channel"], 430, 520))


def window_sql(src: str, lo: float, hi: float, keys: str = "", positive: bool = False, limits: str | None = None, name: str = "SW") -> str:
    k = f"{keys}, " if keys else ""
    where = "value > 0" if positive else "value IS NOT NULL"
    limits = limits or f"(SELECT {k}min(date) AS lo, max(date) AS hi FROM {src} WHERE {where} GROUP BY ALL)"
    join = f"JOIN {name}l USING ({keys})" if keys else f"CROSS JOIN {name}l"
    ang = f"{PI2} * ((k * d) % n / n::DOUBLE)"
    return (
        f", {name}l AS (SELECT *, date_diff('day', lo, hi) + 1 AS n FROM {limits}),"
        f" {name}o AS (SELECT {k}n, date_diff('day', lo, date) AS d FROM {src} {join} WHERE {where} AND date BETWEEN lo AND hi),"
        f" {name}k AS (SELECT {k}n AS nn, unnest(generate_series(CAST(greatest(1, ceil(n / {float(hi)})) AS BIGINT), CAST(least(floor(n / 2.0), floor(n / {float(lo)})) AS BIGINT))) AS k FROM {name}l),"
        f" {name}s AS (SELECT {'o.' + keys + ', ' if keys else ''}n, k, count(*) AS m, sum(cos({ang})) AS c, sum(sin({ang})) AS s FROM {name}o o JOIN {name}k kk ON {'o.' + keys + ' = kk.' + keys if keys else 'true'} GROUP BY ALL),"
        f" {name} AS (SELECT {k}n / k::DOUBLE AS period_days, CASE WHEN 2 * k = n THEN 1.0 ELSE 2.0 END * (c * c + s * s) / n / n AS power FROM {name}s WHERE n >= 10 AND m >= 10 AND m < n)"
    )


@query(with_("O") + window_sql("O", 20, 2500, "channel") + " SELECT channel, round(period_days, 7) AS period_days, round(power, 7) AS power FROM SW")
def sampling_window_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(spectra.sampling_window(inputs.orders(spark, sf_dir), ["channel"], 20, 2500))


_LIM = "(SELECT DISTINCT channel, DATE '1996-03-01' AS lo, DATE '2000-02-29' AS hi FROM O)"


@query(with_("O") + window_sql("O", 20, 700, "channel", True, _LIM) + " SELECT channel, round(period_days, 7) AS period_days, round(power, 7) AS power FROM SW")
def sampling_window_spectrum_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.orders(spark, sf_dir)
    limits = rows.select("channel").distinct().select("channel", F.lit("1996-03-01").cast("date").alias("first"), F.lit("2000-02-29").cast("date").alias("last"))
    return tidy(spectra.sampling_window(rows, ["channel"], 20, 700, positive=True, limits=limits))


def _fourier_sql(low: str, top: str) -> str:
    """The Fourier sums of every channel's positions, harmonics k of n from low to top."""
    angle = f"{PI2} * ((k * i) % n / n::DOUBLE)"
    return with_(
        "O", "I AS (SELECT channel, value, row_number() OVER (PARTITION BY channel ORDER BY date) - 1 AS i FROM O)", "M AS (SELECT channel, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS n FROM O GROUP BY 1)",
        f"KK AS (SELECT channel, n, unnest(generate_series(CAST({low} AS BIGINT), CAST({top} AS BIGINT))) AS k FROM M)", f"FS AS (SELECT I.channel, n, k, sum(value * cos({angle})) AS re, -sum(value * sin({angle})) AS im FROM I JOIN KK ON I.channel = KK.channel GROUP BY ALL)",
    )


_FOURIER = "SELECT channel, round(k / n::DOUBLE, 7) AS frequency_cpd, round(n / k::DOUBLE, 7) AS period_days, round(2 * (re * re + im * im) / 1e15, 7) AS power, round(degrees(atan2(im, re)), {d}) AS phase_deg FROM FS"


@query(_fourier_sql("greatest(1, ceil(n / 700.0))", "least(n / 2 - 1, floor(n / 200.0))") + _FOURIER.format(d=7))
def fft_band_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power in units of 1e15."""
    return tidy(spectra.fourier_band(inputs.orders(spark, sf_dir), ["channel"], LO, HI).withColumn("power", F.col("power") / 1e15))


@query(_fourier_sql("1", "n / 2 - 1") + _FOURIER.format(d=2))
def fft_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power in units of 1e15."""
    got = spectra.fourier_full(inputs.orders(spark, sf_dir), ["channel"]).withColumn("power", F.col("power") / 1e15)
    return tidy(got).withColumn("phase_deg", F.round("phase_deg", 2))


_SPEC = with_("O") + prepared_sql("O", "channel", log10=True) + lomb_sql(_freqs(LO, HI, N), "channel", floating=True)


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.lomb_scargle_log(inputs.orders(spark, sf_dir), ["channel"], LO, HI, N)


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.sampling_window(inputs.orders(spark, sf_dir), ["channel"], LO, HI, positive=True)


def best_sql(src: str, name: str, keys: str = "channel") -> str:
    return f", {name} AS (SELECT * EXCLUDE (lo, hi, r) FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, band ORDER BY power DESC, period_days) AS r FROM {src} JOIN ({bands_sql()}) ON period_days BETWEEN lo AND hi) WHERE r = 1)"


@query(_SPEC + best_sql("LS", "BST") + " SELECT channel, band, round(period_days, 7) AS period_days, round(power, 7) AS power FROM BST")
def spectrum_band_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(peaks.band_maximum(_spectrum(spark, sf_dir), ["channel"], "period_days", "power", BANDS))


_BOTH = _SPEC + window_sql("O", LO, HI, "channel", True) + best_sql("LS", "BS") + best_sql("SW", "BW") + ", BX AS (SELECT BS.channel, BS.band, BS.period_days AS signal, BW.period_days AS window_period, (SELECT date_diff('day', min(date), max(date)) + 1 FROM O o WHERE o.channel = BS.channel AND value > 0) AS span FROM BS LEFT JOIN BW ON BS.channel = BW.channel AND BS.band = BW.band)"


def _signal_and_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = peaks.band_maximum(_spectrum(spark, sf_dir), ["channel"], "period_days", "power", BANDS).select("channel", "band", F.col("period_days").alias("signal"))
    w = peaks.band_maximum(_window(spark, sf_dir), ["channel"], "period_days", "power", BANDS).select("channel", "band", F.col("period_days").alias("window_period"))
    spans = series.spans(inputs.orders(spark, sf_dir).where("value > 0"), ["channel"]).select("channel", (F.datediff("last", "first") + 1).alias("span"))
    return s.join(w, ["channel", "band"], "left").join(spans, "channel")


@query(_BOTH + " SELECT channel, band, round(signal, 7) AS signal, round(window_period, 7) AS window_period, round(signal - window_period, 7) AS difference FROM BX")
def peak_minus_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_signal_and_window(spark, sf_dir).select("channel", "band", "signal", "window_period", (F.col("signal") - F.col("window_period")).alias("difference")))


@query(_BOTH + " SELECT channel, band, span, round(abs(1 / signal - 1 / window_period) * span, 7) AS separation, abs(1 / signal - 1 / window_period) * span <= 1 AS within_one, round(CASE WHEN window_period IS NOT NULL THEN signal * signal / span END, 7) AS period_resolution FROM BX")
def rayleigh_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, w, t = F.col("signal"), F.col("window_period"), F.col("span")
    sep = scalars.rayleigh(s, w, t)
    return tidy(_signal_and_window(spark, sf_dir).select("channel", "band", "span", sep.alias("separation"), (sep <= 1).alias("within_one"), scalars.period_resolution(s, w, t).alias("period_resolution")))


def morph_sql(src: str, name: str, keys: str = "channel") -> str:
    one = keys
    return f", {name}q AS (SELECT * FROM {src})" + _renamed(runs_sql(f"{name}q", "period_days", "power", one) + prominence_sql("period_days", "power", one), name) + best_sql(f"{name}PR", f"{name}B", keys) + f", {name} AS (SELECT {keys}, b.band, period_days, power, CASE b.band " + " ".join(f"WHEN '{b}' THEN period_days <= {lo + 0.02 * (hi - lo)} OR period_days >= {hi - 0.02 * (hi - lo)}" for b, (lo, hi) in BANDS.items()) + f" END AS at_band_edge, peak AS is_local_peak, prominence FROM {name}B b)"


def _renamed(sql: str, prefix: str) -> str:
    import re

    return re.sub(r"\b(P0|P1|P2|PK|WL|PM|PR)\b", lambda m: prefix + m[1], sql)


_M = "round(period_days, 7) AS period_days, round(power, 7) AS power, at_band_edge, is_local_peak, round(prominence, 7) AS prominence"


@query(_SPEC + morph_sql("LS", "MS") + f" SELECT channel, band, {_M} FROM MS")
def spectrum_peak_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(peaks.spectrum_morphology(_spectrum(spark, sf_dir), ["channel"], BANDS))


_TOP = ", {n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY prominence DESC, power DESC, period_days) AS rank FROM {p}PR WHERE peak) WHERE rank <= {k})"


def _top(rows: DataFrame, n: int, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    return peaks.top_peaks(rows, list(keys), "period_days", "power", n, [F.desc("prominence"), F.desc("power"), F.asc("period_days")]).select(*keys, "period_days", "power", "prominence", "rank")


@query(_SPEC + morph_sql("LS", "MS") + _TOP.format(n="TP", p="MS", k=8) + " SELECT channel, round(period_days, 7) AS period_days, round(power, 7) AS power, round(prominence, 7) AS prominence, rank FROM TP")
def top_spectral_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_top(_spectrum(spark, sf_dir), 8))


@query(_SPEC + window_sql("O", LO, HI, "channel", True) + best_sql("LS", "BS") + morph_sql("SW", "MW") + _TOP.format(n="TW", p="MW", k=12) + ", NR AS (SELECT BS.channel, BS.band, BS.period_days AS p, TW.period_days AS w, TW.power AS wp, (SELECT date_diff('day', min(date), max(date)) + 1 FROM O o WHERE o.channel = BS.channel AND value > 0) AS span, row_number() OVER (PARTITION BY BS.channel, BS.band ORDER BY abs(1 / TW.period_days - 1 / BS.period_days), TW.period_days) AS r FROM BS LEFT JOIN TW ON BS.channel = TW.channel) SELECT channel, band, round(p, 7) AS period_days, round(w, 7) AS nearest_window_period_days, round(wp, 7) AS nearest_window_power, round(abs(p - w), 7) AS absolute_period_difference_days, round(abs(1 / w - 1 / p) * span, 7) AS frequency_separation_rayleigh, abs(1 / w - 1 / p) * span <= 1 AS within_one_rayleigh FROM NR WHERE r = 1")
def nearest_window_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = peaks.band_maximum(_spectrum(spark, sf_dir), ["channel"], "period_days", "power", BANDS).select("channel", "band", "period_days")
    spans = series.spans(inputs.orders(spark, sf_dir).where("value > 0"), ["channel"]).select("channel", (F.datediff("last", "first") + 1).alias("span_days"))
    near = peaks.nearest_window_peak(s.join(spans, "channel"), _top(_window(spark, sf_dir), 12), ["channel"])
    return tidy(near.drop("span_days", "nearest_window_prominence"))


# sliding windows

_NW = 1200


def win_sql(years: int = 3) -> str:
    """CTE TR: the tracked peaks of windows of so many years."""
    return with_("O", "A", "B") + windows_sql(years=years) + ", WL2 AS (SELECT 'a' AS side, window_start, window_stop, date, value FROM A JOIN W ON date BETWEEN window_start AND window_stop UNION ALL SELECT 'b', window_start, window_stop, date, value FROM B JOIN W ON date BETWEEN window_start AND window_stop), WS AS (SELECT side || window_start AS sw, side, window_start, window_stop, date, value FROM WL2)" + prepared_sql("WS", "sw", log10=True) + lomb_sql(_freqs(LO, HI, _NW), "sw", floating=True) + window_sql("WS", LO, HI, "sw", True, "(SELECT DISTINCT sw, window_start AS lo, window_stop AS hi FROM WS)") + morph_sql("LS", "MS", "sw") + morph_sql("SW", "MW", "sw") + f", TR AS (SELECT left(MS.sw, 1) AS side, CAST(right(MS.sw, 10) AS DATE) AS window_start, MS.band, MS.period_days AS signal, MS.is_local_peak, MW.period_days AS window_period, date_diff('day', CAST(right(MS.sw, 10) AS DATE), CAST(CAST(right(MS.sw, 10) AS DATE) + INTERVAL {years} YEAR AS DATE)) AS span FROM MS LEFT JOIN MW ON MS.sw = MW.sw AND MS.band = MW.band)"


_WIN = win_sql()
_SEP = "abs(1 / signal - 1 / window_period) * span"


def tracking(spark: SparkSession, sf_dir: str, lengths: Sequence[int] = (3,)) -> DataFrame:
    """(years, side, window_start, band, signal, is_local_peak, window_period, span) in sliding windows of every length of two years or more, each once."""
    wins = [(n, w) for n in sorted({n for n in lengths if n >= 2}) for w in calendar(spark, sf_dir, n)]
    a, b = (x.withColumn("side", F.lit(s)) for x, s in zip(inputs.pair(spark, sf_dir), "ab"))
    return tracked(a.unionByName(b), ["side"], Windows([w for _, w in wins], {"years": [n for n, _ in wins]}), ["years"])


def tracked(rows: DataFrame, keys: Sequence[str], wins: Windows, own: Sequence[str] = ()) -> DataFrame:
    """Band peaks of the signal and of the sampling window in every window: (own, keys, window_start, band, signal, is_local_peak, window_period, span)."""
    by = [*own, *keys, "window_start"]
    s = peaks.spectrum_morphology(spectra.lomb_scargle_log(rows, keys, LO, HI, _NW, windows=wins).withColumn("span", F.datediff("window_stop", "window_start") + 1), [*by, "span"], BANDS)
    w = peaks.spectrum_morphology(waves.sampling_in_windows(rows.where("value > 0"), keys, LO, HI, wins), by, BANDS)
    return s.select(*by, "band", F.col("period_days").alias("signal"), "is_local_peak", F.col("span").cast("long").alias("span")).join(w.select(*by, "band", F.col("period_days").alias("window_period")), [*by, "band"], "left")


def _tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking(spark, sf_dir).drop("years")


@query(_WIN + f" SELECT side, window_start, band, round(signal, 7) AS signal, is_local_peak, round(window_period, 7) AS window_period, span, round({_SEP}, 7) AS separation FROM TR")
def sliding_window_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_tracking(spark, sf_dir).withColumn("separation", scalars.rayleigh(F.col("signal"), F.col("window_period"), F.col("span"))))


_USABLE = f", US AS (SELECT *, {_SEP} AS sep FROM TR WHERE is_local_peak AND signal IS NOT NULL AND window_period IS NOT NULL), TT AS (SELECT side, band, count(*) AS total FROM TR GROUP BY ALL)"


@query(_WIN + _USABLE + ", CR AS (SELECT side, band, count(*) AS n, count(CASE WHEN sep <= 1 THEN 1 END) AS a, median(sep) AS med, CASE WHEN count(*) >= 4 AND stddev_pop(1 / signal) > 0 AND stddev_pop(1 / window_period) > 0 THEN covar_pop(1 / signal, 1 / window_period) / nullif(stddev_pop(1 / signal) * stddev_pop(1 / window_period), 0) END AS c FROM US GROUP BY ALL) SELECT TT.side, TT.band, total AS windows_total, coalesce(n, 0) AS local_peak_windows, coalesce(a, 0) AS alias_windows, round(a / n::DOUBLE, 7) AS alias_fraction, round(med, 7) AS median_separation, round(c, 5) AS frequency_correlation FROM TT LEFT JOIN CR ON TT.side = CR.side AND TT.band = CR.band")
def window_tracking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracking_summary(_tracking(spark, sf_dir), ["side", "band"])
    return tidy(out.withColumn("frequency_correlation", F.round("frequency_correlation", 5)))


def tracking_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Over windows whose signal is a local peak: counts, alias share, median separation and correlation of the two frequencies (4 windows or more)."""
    fs, fw = 1 / F.col("signal"), 1 / F.col("window_period")
    usable = F.col("is_local_peak") & F.col("signal").isNotNull() & F.col("window_period").isNotNull()
    sep = F.when(usable, scalars.rayleigh(F.col("signal"), F.col("window_period"), F.col("span")))
    x, y = F.when(usable, fs), F.when(usable, fw)
    got = rows.groupBy(*keys).agg(
        F.count("*").alias("windows_total"), F.count_if(usable).alias("local_peak_windows"), F.count_if(sep <= 1).alias("alias_windows"), F.median(sep).alias("median_separation"),
        F.covar_pop(x, y).alias("_c"), F.stddev_pop(x).alias("_x"), F.stddev_pop(y).alias("_y"),
    )
    corr = F.when((F.col("local_peak_windows") >= 4) & (F.col("_x") > 0) & (F.col("_y") > 0), F.try_divide(F.col("_c"), F.col("_x") * F.col("_y")))
    return got.select(*keys, "windows_total", "local_peak_windows", "alias_windows", F.try_divide(F.col("alias_windows").cast("double"), F.col("local_peak_windows")).alias("alias_fraction"), "median_separation", corr.alias("frequency_correlation"))


@query(_WIN + _USABLE + " SELECT TT.side, TT.band, any_value(total) AS windows_total, count(sep) AS local_peak_windows, round(median(sep), 7) AS median_rayleigh, round(median(abs(signal - window_period)), 7) AS median_period_difference_days, round(median(signal * signal / span), 7) AS median_period_resolution_days FROM TT LEFT JOIN US ON TT.side = US.side AND TT.band = US.band GROUP BY ALL")
def scale_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(summary_by_scale(_tracking(spark, sf_dir), ["side", "band"]).drop("alias_windows", "alias_fraction"))


def summary_by_scale(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, over windows whose signal is a local peak: counts, share within one Rayleigh step of the sampling window, and medians."""
    usable = F.col("is_local_peak") & F.col("window_period").isNotNull()
    s, w, t = F.when(usable, F.col("signal")), F.col("window_period"), F.col("span")
    got = rows.groupBy(*keys).agg(
        F.count("*").alias("windows_total"), F.count(s).alias("local_peak_windows"), F.count_if(scalars.rayleigh(s, w, t) <= 1).alias("alias_windows"), F.median(scalars.rayleigh(s, w, t)).alias("median_rayleigh"),
        F.median(F.abs(s - w)).alias("median_period_difference_days"), F.median(scalars.period_resolution(s, w, t)).alias("median_period_resolution_days"),
    )
    return got.withColumn("alias_fraction", F.try_divide(F.col("alias_windows").cast("double"), F.col("local_peak_windows")))


@query(_WIN + ", CO AS (SELECT a.window_start, a.band, a.signal AS pa, b.signal AS pb, a.is_local_peak AND b.is_local_peak AS both_peaks FROM TR a JOIN TR b ON a.window_start = b.window_start AND a.band = b.band WHERE a.side = 'a' AND b.side = 'b') SELECT window_start, band, round(abs(pa - pb), 7) AS difference, round(abs(pa - pb) / ((pa + pb) / 2), 7) AS relative, abs(pa - pb) / ((pa + pb) / 2) <= 0.1 AS within_10_percent, both_peaks FROM CO")
def period_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tracking(spark, sf_dir)
    side = lambda s: rows.where(F.col("side") == s).select("window_start", "band", F.col("signal").alias(f"p{s}"), F.col("is_local_peak").alias(f"k{s}"))
    gap, relative, close = scalars.concordance(F.col("pa"), F.col("pb"))
    return tidy(side("a").join(side("b"), ["window_start", "band"]).select("window_start", "band", gap.alias("difference"), relative.alias("relative"), close.alias("within_10_percent"), (F.col("ka") & F.col("kb")).alias("both_peaks")))


_JP = 96
_JW = with_("O", "A", "B") + windows_sql() + ", WS AS (SELECT 'a' || window_start AS sw, date, value FROM A JOIN W ON date BETWEEN window_start AND window_stop UNION ALL SELECT 'b' || window_start, date, value FROM B JOIN W ON date BETWEEN window_start AND window_stop)" + prepared_sql("WS", "sw", "linear", log10=True) + lomb_sql(_periods(430, 520, _JP), "sw", least=180) + ", JJ AS (SELECT CAST(right(p.sw, 10) AS DATE) AS window_start, p.period_days, p.power AS power_a, q.power AS power_b, sqrt(greatest(p.power, 0) * greatest(q.power, 0)) AS joint FROM LS p JOIN LS q ON left(p.sw, 1) = 'a' AND left(q.sw, 1) = 'b' AND right(p.sw, 10) = right(q.sw, 10) AND abs(p.period_days - q.period_days) < 1e-6)"


def _joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_start, k, period_days, power_a, power_b, joint): both sides' spectra and their geometric mean in windows with 180 values of each."""
    a, b = (x.withColumn("side", F.lit(s)) for x, s in zip(inputs.pair(spark, sf_dir), "ab"))
    return joint_power(a.unionByName(b), [], Windows(calendar(spark, sf_dir)), 430, 520, _JP)


def joint_power(rows: DataFrame, keys: Sequence[str], wins: Windows, lo: float, hi: float, n: int, detrend: str = "linear", least: int = 180, transform: str = "log10") -> DataFrame:
    """(keys, window_start, period_days, power_a, power_b, joint) of the sides a and b of rows."""
    by, k = [*keys, "window_start"], F.round("period_days", 6).alias("k")
    each = spectra.lomb_scargle_periods(rows, [*keys, "side"], lo, hi, n, detrend, least, wins, transform)
    both = each.groupBy(*by, k).agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in "ab" for c in ("power", "period_days")))
    zero = F.lit(0.0)
    joint = F.sqrt(F.greatest(zero, F.col("power_a")) * F.greatest(zero, F.col("power_b")))
    return both.where("power_a IS NOT NULL AND power_b IS NOT NULL").select(*by, F.col("period_days_a").alias("period_days"), "power_a", "power_b", joint.alias("joint"))


@query(_JW + " SELECT window_start, round(period_days, 7) AS period_days, round(power_a, 7) AS power_a, round(power_b, 7) AS power_b, round(joint, 7) AS joint FROM JJ")
def joint_window_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_joint(spark, sf_dir))


@query(_JW + ", ST AS (SELECT 'a' AS statistic, window_start, period_days, power_a AS power FROM JJ UNION ALL SELECT 'b', window_start, period_days, power_b FROM JJ UNION ALL SELECT 'joint', window_start, period_days, joint FROM JJ), Z AS (SELECT *, row_number() OVER (PARTITION BY statistic ORDER BY power DESC, window_start, period_days) AS r FROM ST) SELECT statistic, window_start, round(period_days, 7) AS period_days, round(power, 7) AS power FROM Z WHERE r = 1")
def joint_window_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _joint(spark, sf_dir).select("window_start", "period_days", F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(c).alias("power")) for n, c in (("a", "power_a"), ("b", "power_b"), ("joint", "joint"))))).alias("s"))
    best = F.max_by(F.struct("window_start", "period_days", F.col("s.power").alias("power")), F.struct(F.col("s.power").alias("p"), (-F.unix_date("window_start")).alias("w"), (-F.col("period_days")).alias("d")))
    return tidy(long.groupBy(F.col("s.statistic").alias("statistic")).agg(best.alias("b")).select("statistic", "b.*"))
