"""Queries of calendar-lag correlation, discrete correlation functions and their peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lagcorr, peaks, series
from . import inputs
from .inputs import BANDS, with_
from .registry import query, tidy
from .series_queries import runs_sql

LO, HI, WIDTH, LEAST = 250, 600, 10, 100


def bands_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{b}' AS band, {lo} AS lo, {hi} AS hi" for b, (lo, hi) in BANDS.items())


def _pairs_sql(x: str, y: str, lo: int, hi: int) -> str:
    """Pair statistics at calendar lags, as CTE PS."""
    guard = lambda n, sx, sy, sxx, syy, sxy: f"CASE WHEN {n} >= 3 AND {sxx} - {sx} * {sx} / {n} > 1e-12 * {sxx} AND {syy} - {sy} * {sy} / {n} > 1e-12 * {syy} THEN ({sxy} - {sx} * {sy} / {n}) / sqrt(({sxx} - {sx} * {sx} / {n}) * ({syy} - {sy} * {sy} / {n})) END"
    return (
        f", K AS (SELECT unnest(generate_series({lo}, {hi})) AS k), J AS (SELECT k, p.value AS x, q.value AS y FROM K JOIN {y} q ON true JOIN {x} p ON p.date = q.date + CAST(k AS INT)),"
        " S AS (SELECT k, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM J GROUP BY 1),"
        " L AS (SELECT k, count(*) AS n, sum(log10(x)) AS sx, sum(log10(y)) AS sy, sum(log10(x) * log10(x)) AS sxx, sum(log10(y) * log10(y)) AS syy, sum(log10(x) * log10(y)) AS sxy FROM J WHERE x > 0 AND y > 0 GROUP BY 1),"
        f" PS AS (SELECT CAST(S.k AS BIGINT) AS lag_calendar_days, S.n AS pairs, S.sxy / nullif(sqrt(S.sxx * S.syy), 0) AS cosine_raw, {guard('S.n', 'S.sx', 'S.sy', 'S.sxx', 'S.syy', 'S.sxy')} AS pearson_raw, {guard('L.n', 'L.sx', 'L.sy', 'L.sxx', 'L.syy', 'L.sxy')} AS pearson_log10, coalesce(L.n, 0) AS log_pairs FROM S LEFT JOIN L ON S.k = L.k)"
    )


_STATS = "lag_calendar_days, pairs, round(cosine_raw, 7) AS cosine_raw, round(pearson_raw, 7) AS pearson_raw, round(pearson_log10, 7) AS pearson_log10, log_pairs"
_CAL_CCF = with_("O", "A", "B") + _pairs_sql("A", "B", -LO, HI)


@query(with_("O", "A") + _pairs_sql("A", "A", 1, 2500) + f" SELECT {_STATS} FROM PS")
def calendar_acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(lagcorr.calendar_autocorrelation(inputs.pair(spark, sf_dir)[0], [], 1, 2500))


def _calendar_ccf(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = inputs.pair(spark, sf_dir)
    return lagcorr.calendar_correlation(a, b, [], -LO, HI).withColumn("lag_calendar_days", F.col("lag_calendar_days").cast("long"))


@query(_CAL_CCF + f" SELECT {_STATS} FROM PS")
def calendar_ccf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_calendar_ccf(spark, sf_dir))


@query(_CAL_CCF + f", BB AS ({bands_sql()}), Z AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY pearson_log10 DESC, lag_calendar_days) AS r FROM PS JOIN BB ON lag_calendar_days BETWEEN lo AND hi WHERE pairs >= {LEAST} AND pearson_log10 IS NOT NULL) SELECT band, lag_calendar_days, round(pearson_log10, 7) AS pearson_log10, pairs, log_pairs FROM Z WHERE r = 1")
def calendar_lag_band_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(peaks.band_maximum(_calendar_ccf(spark, sf_dir), [], "lag_calendar_days", "pearson_log10", BANDS, LEAST, others=["pairs", "log_pairs"]))


_FIXED = (340, 341, 365, 467, 469, 470, 9999)


@query(_CAL_CCF + f", P AS (SELECT unnest([{', '.join(map(str, _FIXED))}]) AS k) SELECT CAST(k AS BIGINT) AS lag_calendar_days, coalesce(pairs, 0) AS pairs, round(cosine_raw, 7) AS cosine_raw, round(pearson_raw, 7) AS pearson_raw, round(pearson_log10, 7) AS pearson_log10, coalesce(log_pairs, 0) AS log_pairs FROM P LEFT JOIN PS ON k = lag_calendar_days")
def calendar_lag_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(peaks.at_points(_calendar_ccf(spark, sf_dir), [], "lag_calendar_days", _FIXED, {"pairs": 0, "log_pairs": 0}))


def z_sql(name: str, src: str, keys: str = "") -> str:
    """CTE name: standardised log10 of src."""
    k = f"{keys}, " if keys else ""
    by = f"PARTITION BY {keys}" if keys else ""
    return f", {name} AS (SELECT {k}date, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z FROM (SELECT {k}date, log10(value) AS v FROM {src} WHERE value > 0) WINDOW w AS ({by}))"


def dcf_sql(a: str, b: str, lo: int, hi: int, keys: str = "") -> str:
    """CTEs D (by lag) and DB (by bin) of standardised series a and b."""
    k, on = (f"{keys}, ", f"p.{keys} = q.{keys} AND ") if keys else ("", "")
    kq = f"q.{keys}, " if keys else ""
    err = "CASE WHEN n >= 2 THEN sqrt(greatest(0.0, (q - s * s / n) / (n - 1)) / n) END"
    every = f"(SELECT * FROM (SELECT DISTINCT {keys} FROM {a}), K)" if keys else "K"
    return (
        f", K AS (SELECT unnest(generate_series({lo}, {hi})) AS k), DK AS (SELECT {k}k, z, date + CAST(k AS INT) AS date FROM {b}, K), D0 AS (SELECT {kq}k, count(*) AS n, sum(p.z * q.z) AS s, sum(p.z * q.z * p.z * q.z) AS q FROM DK q JOIN {a} p ON {on}p.date = q.date GROUP BY ALL),"
        f" D AS (SELECT {k}CAST(k AS BIGINT) AS lag_calendar_days, coalesce(n, 0) AS pairs, s / n AS dcf, {err} AS stderr, coalesce(s, 0) AS sum_udcf, coalesce(q, 0) AS sum_sq_udcf FROM {every} LEFT JOIN D0 USING ({k}k)),"
        f" D1 AS (SELECT {k}CAST(floor((lag_calendar_days - {lo}) / {WIDTH}) AS BIGINT) AS b, CAST(sum(pairs) AS BIGINT) AS n, sum(sum_udcf) AS s, sum(sum_sq_udcf) AS q FROM D GROUP BY ALL),"
        f" DB AS (SELECT {k}{lo} + b * {WIDTH} AS lag_bin_start, {lo} + b * {WIDTH} + {WIDTH - 1} AS lag_bin_end, {lo} + b * {WIDTH} + {(WIDTH - 1) / 2}::DOUBLE AS lag_bin_center, n AS pairs, s / nullif(n, 0) AS dcf, {err} AS stderr FROM D1)"
    )


_DCF = with_("O", "A", "B") + z_sql("ZA", "A") + z_sql("ZB", "B") + dcf_sql("ZA", "ZB", LO, HI)


def _dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lagcorr.discrete_correlation(*inputs.pair(spark, sf_dir), [], LO, HI)


@query(_DCF + " SELECT lag_calendar_days, pairs, round(dcf, 7) AS dcf, round(stderr, 7) AS stderr, round(sum_udcf, 7) + 0.0 AS sum_udcf, round(sum_sq_udcf, 7) AS sum_sq_udcf FROM D")
def dcf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_dcf(spark, sf_dir))


_BINNED = "lag_bin_start, lag_bin_end, lag_bin_center, pairs, round(dcf, 7) AS dcf, round(stderr, 7) AS stderr"


@query(_DCF + f" SELECT {_BINNED} FROM DB")
def dcf_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(lagcorr.binned(_dcf(spark, sf_dir), [], WIDTH, LO))


@query(with_("R", "RA AS (SELECT date, value FROM R WHERE channel = 'R')", "RB AS (SELECT date, value FROM R WHERE channel = 'A')") + z_sql("ZA", "RA") + z_sql("ZB", "RB") + dcf_sql("ZA", "ZB", LO, HI) + f" SELECT {_BINNED} FROM DB")
def calendar_dcf_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned against accepted line revenue, in 10-day bins of 250 to 600 days."""
    rows = inputs.revenue(spark, sf_dir)
    a, b = (rows.where(F.col("channel") == c).select("date", "value") for c in "RA")
    return tidy(lagcorr.binned(lagcorr.discrete_correlation(a, b, [], LO, HI), [], WIDTH, LO))


_BEST = ", BB AS ({bands}), Z AS (SELECT *, row_number() OVER (PARTITION BY {k}band ORDER BY dcf DESC, lag_bin_center) AS r FROM DB JOIN BB ON lag_bin_center BETWEEN lo AND hi WHERE pairs >= {least} AND dcf IS NOT NULL)"


@query(_DCF + _BEST.format(bands=bands_sql(), k="", least=LEAST) + " SELECT band, lag_bin_center, round(dcf, 7) AS dcf, pairs FROM Z WHERE r = 1")
def dcf_band_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = lagcorr.binned(_dcf(spark, sf_dir), [], WIDTH, LO)
    return tidy(peaks.band_maximum(binned, [], "lag_bin_center", "dcf", BANDS, LEAST, others=["pairs"]))


def _channels_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.orders(spark, sf_dir)
    return lagcorr.binned(lagcorr.discrete_correlation(rows, rows, ["channel"], LO, HI), ["channel"], WIDTH, LO)


CHANNELS_DCF = with_("O") + z_sql("ZC", "O", "channel") + dcf_sql("ZC", "ZC", LO, HI, "channel")


@query(CHANNELS_DCF + f" SELECT channel, {_BINNED} FROM DB")
def dcf_all_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation DCF of every channel in one job."""
    return tidy(_channels_dcf(spark, sf_dir))


_CS = ", SP AS (SELECT greatest((SELECT min(date) FROM A WHERE value > 0), (SELECT min(date) FROM B WHERE value > 0)) AS lo, least((SELECT max(date) FROM A WHERE value > 0), (SELECT max(date) FROM B WHERE value > 0)) AS hi), CA AS (SELECT date, value FROM A, SP WHERE date BETWEEN lo AND hi), CB AS (SELECT date, value FROM B, SP WHERE date BETWEEN lo AND hi)"


@query(with_("O", "A", "B") + _CS + z_sql("ZA", "CA") + z_sql("ZB", "CB") + dcf_sql("ZA", "ZB", LO, HI) + " SELECT lag_bin_start, lag_bin_end, lag_bin_center, pairs, round(dcf, 7) AS dcf FROM DB WHERE pairs > 0")
def dcf_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCF of series standardised within their common span, as pair-weighted means per bin."""
    both = [series.transformed(x, "log10") for x in inputs.pair(spark, sf_dir)]
    span = series.common_span(both[0].withColumn("side", F.lit(0)).unionByName(both[1].withColumn("side", F.lit(1))), ["side"])
    a, b = (x.join(F.broadcast(span), F.col("date").between(F.col("first"), F.col("last"))).select("date", "value") for x in both)
    return tidy(lagcorr.binned_means(lagcorr.discrete_correlation(a, b, [], LO, HI, "raw"), [], WIDTH, LO))


def prominence_sql(x: str, y: str, keys: str = "") -> str:
    """CTE PR: PK with prominence."""
    on = f"a.{keys} = b.{keys} AND " if keys else ""
    wall = lambda side, agg: f"(SELECT {agg}(b.i) FROM PK b WHERE {on}b.i {side} a.i AND b.{y} > a.{y})"
    return (
        f", WL AS (SELECT a.*, {wall('<', 'max')} AS wl, {wall('>', 'min')} AS wr FROM PK a WHERE peak),"
        f" PM AS (SELECT a.* EXCLUDE (wl, wr), a.{y} - greatest((SELECT min(b.{y}) FROM PK b WHERE {on}b.i <= a.i AND b.i > coalesce(a.wl, 0)), (SELECT min(b.{y}) FROM PK b WHERE {on}b.i >= a.i AND b.i < coalesce(a.wr, 1000000000))) AS prominence FROM WL a),"
        f" PR AS (SELECT *, 0.0::DOUBLE AS prominence FROM PK WHERE NOT peak UNION ALL SELECT * FROM PM)"
    )


_MORPH = CHANNELS_DCF + f", Q AS (SELECT * FROM DB WHERE pairs >= {LEAST} AND dcf IS NOT NULL)" + runs_sql("Q", "lag_bin_center", "dcf", "channel") + prominence_sql("lag_bin_center", "dcf", "channel")


@query(_MORPH + f", BB AS ({bands_sql()}), Z AS (SELECT *, row_number() OVER (PARTITION BY channel, band ORDER BY dcf DESC, lag_bin_center) AS r FROM PR JOIN BB ON lag_bin_center BETWEEN lo AND hi) SELECT channel, band, lag_bin_center, round(dcf, 7) AS dcf, pairs, lag_bin_center <= lo + {WIDTH / 2} OR lag_bin_center >= hi - {WIDTH / 2} AS at_band_edge, peak AS is_local_peak, round(prominence, 7) AS prominence FROM Z WHERE r = 1")
def dcf_peak_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(peaks.lag_morphology(_channels_dcf(spark, sf_dir), ["channel"], BANDS, LEAST))


@query(_MORPH + ", Z AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY prominence DESC, dcf DESC, lag_bin_center) AS rank FROM PR WHERE peak) SELECT channel, lag_bin_center, round(dcf, 7) AS dcf, pairs, round(prominence, 7) AS prominence, rank FROM Z WHERE rank <= 6")
def top_prominent_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _channels_dcf(spark, sf_dir).where(F.col("pairs") >= LEAST)
    return tidy(peaks.top_peaks(rows, ["channel"], "lag_bin_center", "dcf", 6, [F.desc("prominence"), F.desc("dcf"), F.asc("lag_bin_center")]).select("channel", "lag_bin_center", "dcf", "pairs", "prominence", "rank"))


_YEARS = 3


def _windows_sql(years: int = _YEARS) -> str:
    """CTE W: windows of so many years within the days that A and B share, from O."""
    ends = ", ".join(f"{f}({g}(date) FILTER (channel = '{inputs.A}'), {g}(date) FILTER (channel = '{inputs.B}')) AS {n}" for f, g, n in (("greatest", "min", "lo"), ("least", "max", "hi")))
    return f", WE AS (SELECT {ends} FROM O), WN AS (SELECT lo AS ws FROM WE UNION ALL SELECT CAST(ws + INTERVAL 1 YEAR AS DATE) FROM WN, WE WHERE ws < hi), W AS (SELECT ws AS window_start, CAST(ws + to_years({years}) - INTERVAL 1 DAY AS DATE) AS window_stop FROM WN, WE WHERE ws + to_years({years}) - INTERVAL 1 DAY <= hi)"


def calendar(spark: SparkSession, sf_dir: str, years: int = _YEARS) -> list:
    """Windows of so many years within the days that A and B share."""
    a, b = (x.withColumn("side", F.lit(s)) for x, s in zip(inputs.pair(spark, sf_dir), "ab"))
    span = series.common_span(a.unionByName(b), ["side"]).first()
    return series.calendar_windows(span["first"], span["last"], years) if span else []


def windows(spark: SparkSession, sf_dir: str, years: int = _YEARS) -> DataFrame:
    return series.windows_frame(spark, calendar(spark, sf_dir, years))


_WIN = with_("O", "A", "B") + _windows_sql() + ", WA AS (SELECT window_start, date, value FROM A JOIN W ON date BETWEEN window_start AND window_stop), WB AS (SELECT window_start, date, value FROM B JOIN W ON date BETWEEN window_start AND window_stop)" + z_sql("ZA", "WA", "window_start") + z_sql("ZB", "WB", "window_start") + dcf_sql("ZA", "ZB", LO, HI, "window_start")


@query(_WIN + _BEST.format(bands=bands_sql(), k="window_start, ", least=30) + " SELECT window_start, band, lag_bin_center, round(dcf, 7) AS dcf, pairs FROM Z WHERE r = 1")
def sliding_window_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bins of the cross DCF in sliding three-year windows, standardised within each."""
    wins = windows(spark, sf_dir)
    a, b = (series.in_windows(x, wins).select("window_start", "date", "value") for x in inputs.pair(spark, sf_dir))
    dcf = lagcorr.binned(lagcorr.discrete_correlation(a, b, ["window_start"], LO, HI), ["window_start"], WIDTH, LO)
    return tidy(peaks.band_maximum(dcf, ["window_start"], "lag_bin_center", "dcf", BANDS, 30, others=["pairs"]))
