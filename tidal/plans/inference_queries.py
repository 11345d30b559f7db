"""Queries of red-noise estimates, nulls, adjustment of p-values and reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import multiplicity, noise, nulls, peaks, series, spectra
from ..sources.store import written
from . import inputs, lag_queries, spectral_queries
from .inputs import BANDS, with_
from .lag_queries import HI, LEAST, LO, bands_sql, dcf_sql, z_sql
from .registry import query, tidy
from .spectral_queries import PI2, _freqs, _periods, lomb_sql, prepared_sql

SEED = 1998


@query(with_("O") + ", Y AS (SELECT channel, date, value - avg(value) OVER (PARTITION BY channel) AS y FROM O), Z AS (SELECT channel, y, lead(y) OVER (PARTITION BY channel ORDER BY date) AS z FROM Y) SELECT channel, round(coalesce(greatest(-0.98, least(0.98, sum(y * z) / nullif(sum(CASE WHEN z IS NOT NULL THEN y * y END), 0))), 0), 7) AS phi FROM Z GROUP BY 1")
def ar1_row_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(nulls.ar1_by_row(inputs.orders(spark, sf_dir), ["channel"]))


def _day_phi_sql(src: str, value: str, keys: str = "channel", name: str = "PH") -> str:
    return f", {name}y AS (SELECT {keys}, date, {value} - avg({value}) OVER (PARTITION BY {keys}) AS y FROM {src} WHERE value > 0), {name}z AS (SELECT {keys}, y, CASE WHEN date_diff('day', date, lead(date) OVER w) = 1 THEN lead(y) OVER w END AS z FROM {name}y WINDOW w AS (PARTITION BY {keys} ORDER BY date)), {name} AS (SELECT {keys}, coalesce(CASE WHEN count(z) >= 3 THEN greatest(-0.995, least(0.995, sum(y * z) / nullif(sum(CASE WHEN z IS NOT NULL THEN y * y END), 0))) END, 0) AS phi, count(z) AS pairs FROM {name}z GROUP BY ALL)"


@query(with_("O") + _day_phi_sql("O", "log10(value)") + " SELECT channel, round(phi, 7) AS phi, pairs FROM PH")
def ar1_calendar_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(nulls.ar1_by_day(series.transformed(inputs.orders(spark, sf_dir), "log10"), ["channel"]))


# adjustment and review; the p-values are stand-ins made from DCF bins

_P = lag_queries.CHANNELS_DCF + f", BB AS ({bands_sql()}), Z AS (SELECT *, row_number() OVER (PARTITION BY channel, band ORDER BY dcf DESC, lag_bin_center) AS r FROM DB JOIN BB ON lag_bin_center BETWEEN lo AND hi WHERE pairs >= {LEAST} AND dcf IS NOT NULL), PV AS (SELECT channel, band, variant, lag_bin_center AS lag_days, dcf, CASE WHEN channel = '5-LOW' AND band = 'long' THEN NULL ELSE round(exp(-variant * abs(dcf) * sqrt(pairs)), 6) END AS p FROM Z, (SELECT unnest([1, 3]) AS variant) WHERE r = 1)"
_ADJ = _P + ", RK AS (SELECT *, row_number() OVER (PARTITION BY band, variant ORDER BY p, channel) AS i, count(p) OVER (PARTITION BY band, variant) AS m FROM PV WHERE p IS NOT NULL), AJ AS (SELECT channel, band, variant, max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY band, variant ORDER BY i) AS p_holm, min(least(1.0, m * p / i)) OVER (PARTITION BY band, variant ORDER BY i DESC) AS q_bh FROM RK), AD AS (SELECT PV.*, p_holm, q_bh FROM PV LEFT JOIN AJ ON PV.channel = AJ.channel AND PV.band = AJ.band AND PV.variant = AJ.variant)"


def _adjusted(spark: SparkSession, sf_dir: str, others: Sequence[str] = ()) -> DataFrame:
    best = peaks.band_maximum(lag_queries._channels_dcf(spark, sf_dir), ["channel"], "lag_bin_center", "dcf", BANDS, LEAST, others=["pairs"])
    rows = best.withColumn("variant", F.explode(F.array(F.lit(1), F.lit(3))))
    p = F.when(~((F.col("channel") == "5-LOW") & (F.col("band") == "long")), F.round(F.exp(-F.col("variant") * F.abs("dcf") * F.sqrt("pairs")), 6))
    rows = rows.select("channel", "band", "variant", F.col("lag_bin_center").alias("lag_days"), "dcf", *others, p.alias("p"))
    return multiplicity.adjusted(rows, ["band", "variant"], order=["channel"])


@query(_ADJ + " SELECT channel, band, CAST(variant AS BIGINT) AS variant, lag_days, round(dcf, 7) AS dcf, round(p, 7) AS p, round(p_holm, 7) AS p_holm, round(q_bh, 7) AS q_bh FROM AD")
def holm_bh_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_adjusted(spark, sf_dir))


@query(_ADJ + ", RV AS (SELECT channel, band, max(CASE WHEN variant = 1 THEN p END) AS raw_p, max(CASE WHEN variant = 1 THEN q_bh END) AS raw_fdr, max(CASE WHEN variant = 3 THEN p END) AS detrended_p, max(CASE WHEN variant = 3 THEN q_bh END) AS detrended_fdr FROM AD GROUP BY ALL) SELECT channel, band, round(raw_p, 7) AS raw_p, round(raw_fdr, 7) AS raw_fdr, round(detrended_p, 7) AS detrended_p, round(detrended_fdr, 7) AS detrended_fdr, coalesce(raw_fdr < 0.05, false) AS raw_significant, coalesce(detrended_fdr < 0.05, false) AS detrended_significant, coalesce(raw_fdr < 0.05 AND detrended_fdr < 0.05, false) AS robust, coalesce(abs(raw_p - 1 / 2000.0::DOUBLE) < 1e-12, false) AS raw_at_floor, channel IN ('1-URGENT', '3-MEDIUM') AS quality_limited FROM RV")
def candidate_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(review(_adjusted(spark, sf_dir).withColumn("variant", F.when(F.col("variant") == 1, "raw").otherwise("detrended")), ["channel", "band"], 1999).withColumn("quality_limited", F.col("channel").isin(*inputs.AFFECTED)))


def review(rows: DataFrame, keys: list[str], simulations: int, level: float = 0.05) -> DataFrame:
    """One row per key from rows (keys, variant raw or detrended, p, q_bh): p and FDR by variant, significance at level in each and in both, and whether p is at the Monte-Carlo floor."""
    wide = rows.groupBy(*keys).pivot("variant", ["raw", "detrended"]).agg(F.first("p", ignorenulls=True).alias("p"), F.first("q_bh", ignorenulls=True).alias("fdr"))
    no = F.lit(False)
    raw, det = F.coalesce(F.col("raw_fdr") < level, no), F.coalesce(F.col("detrended_fdr") < level, no)
    return wide.select(*keys, "raw_p", "raw_fdr", "detrended_p", "detrended_fdr", raw.alias("raw_significant"), det.alias("detrended_significant"), (raw & det).alias("robust"), F.coalesce(multiplicity.at_floor(F.col("raw_p"), simulations), no).alias("raw_at_floor"))


_EV = spectral_queries._SPEC + spectral_queries.morph_sql("LS", "MS") + prepared_sql("O", "channel", "none", True, "LR0") + lomb_sql(spectral_queries._freqs(spectral_queries.LO, spectral_queries.HI, spectral_queries.N), "channel", True, src="LR0", name="LR") + spectral_queries.morph_sql("LR", "MR")


@query(_EV + " SELECT MS.channel, MS.band, round(MS.period_days, 7) AS detrended_period, round(MR.period_days, 7) AS raw_period, MS.is_local_peak AND MR.is_local_peak AS both_local_peaks, MS.at_band_edge OR MR.at_band_edge AS either_at_edge, abs(MS.period_days - MR.period_days) / ((MS.period_days + MR.period_days) / 2) <= 0.1 AS within_10_percent FROM MS JOIN MR ON MS.channel = MR.channel AND MS.band = MR.band")
def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the band peaks of the detrended and the plain spectrum."""
    rows, n = inputs.orders(spark, sf_dir), spectral_queries
    got = [peaks.spectrum_morphology(spectra.lomb_scargle_log(rows, ["channel"], n.LO, n.HI, n.N, d), ["channel"], BANDS) for d in ("linear", "none")]
    named = [g.select("channel", "band", *(F.col(c).alias(f"{p}_{c}") for c in ("period_days", "is_local_peak", "at_band_edge"))) for g, p in zip(got, "dr")]
    both = named[0].join(named[1], ["channel", "band"])
    c = F.col
    return tidy(both.select(
        "channel", "band", c("d_period_days").alias("detrended_period"), c("r_period_days").alias("raw_period"), (c("d_is_local_peak") & c("r_is_local_peak")).alias("both_local_peaks"),
        (c("d_at_band_edge") | c("r_at_band_edge")).alias("either_at_edge"), (F.abs(c("d_period_days") - c("r_period_days")) / ((c("d_period_days") + c("r_period_days")) / 2) <= 0.1).alias("within_10_percent"),
    ))


_SCREEN = lag_queries.CHANNELS_DCF + f", BB AS ({bands_sql()}), Z AS (SELECT *, row_number() OVER (PARTITION BY channel, band ORDER BY dcf DESC, lag_bin_center) AS r FROM DB JOIN BB ON lag_bin_center BETWEEN lo AND hi WHERE pairs >= {LEAST} AND dcf IS NOT NULL)" + prepared_sql("O", "channel", log10=True) + lomb_sql(spectral_queries._freqs(250, 600, 6000), "channel", True) + spectral_queries.best_sql("LS", "BS") + spectral_queries.window_sql("O", 250, 600, "channel", True) + spectral_queries.best_sql("SW", "BW")


@query(_SCREEN + " SELECT Z.channel, Z.band, lag_bin_center AS dcf_lag, round(dcf, 7) AS dcf, round(BS.period_days, 7) AS ls_period, round(BS.power, 7) AS ls_power, round(BW.period_days, 7) AS window_period, round(greatest(dcf, BS.power), 7) AS screen_score FROM Z LEFT JOIN BS ON Z.channel = BS.channel AND Z.band = BS.band LEFT JOIN BW ON Z.channel = BW.channel AND Z.band = BW.band WHERE r = 1")
def screening_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best DCF bin, spectral peak and window peak of every channel and band."""
    rows, keys = inputs.orders(spark, sf_dir), ["channel"]
    d = peaks.band_maximum(lag_queries._channels_dcf(spark, sf_dir), keys, "lag_bin_center", "dcf", BANDS, LEAST).select("channel", "band", F.col("lag_bin_center").alias("dcf_lag"), "dcf")
    s = peaks.band_maximum(spectra.lomb_scargle_log(rows, keys, 250, 600, 6000), keys, "period_days", "power", BANDS).select("channel", "band", F.col("period_days").alias("ls_period"), F.col("power").alias("ls_power"))
    w = peaks.band_maximum(spectra.sampling_window(rows, keys, 250, 600, positive=True), keys, "period_days", "power", BANDS).select("channel", "band", F.col("period_days").alias("window_period"))
    return tidy(d.join(s, ["channel", "band"], "left").join(w, ["channel", "band"], "left").withColumn("screen_score", F.greatest("dcf", "ls_power")))


# nulls

def _mixed_sql(source: str, name: str) -> str:
    """Columns that end in name: a 32-bit number, mixed."""
    a, b, c = noise.SHIFTS
    return (
        f"{source} AS {name}0, xor({name}0, {name}0 >> {a}) AS {name}1, ({name}1 * {noise.FIRST}) % 4294967296 AS {name}2, xor({name}2, {name}2 >> {b}) AS {name}3,"
        f" ({name}3 * {noise.SECOND}) % 4294967296 AS {name}4, xor({name}4, {name}4 >> {c}) AS {name}"
    )


def _stream_sql(key: str) -> str:
    return f"xor(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT), {int(noise.mixed(SEED))})"


_BLOCK = 16


def noise_sql(days: str, key: str, simulations: int, name: str = "NZ", text: str | None = None, stationary: bool = True, at: str = "date_diff('day', DATE '1970-01-01', date)") -> str:
    """CTE name: (key, sim, date, value) of the surrogates on the days of (key, date, phi), by the affine maps of blocks of 16 days; text: what the noise is named by, if not the key."""
    lags = " + ".join(f"pow(phi, {k}) * coalesce(lag(w, {k}) OVER b, 0)" for k in range(1, _BLOCK))
    first = "e" if stationary else "0"
    return (
        f", {name}l AS (SELECT {key}, any_value(phi) AS phi, min({at}) AS lo, max({at}) AS hi FROM {days} GROUP BY 1),"
        f" {name}s AS (SELECT {key}, phi, lo, hi, sim, {_mixed_sql(_stream_sql(text or key), 'g')}, {_mixed_sql('sim', 'h')}, {_mixed_sql('xor(g, h)', 'own')} FROM {name}l, (SELECT unnest(generate_series(0, {simulations - 1})) AS sim)),"
        f" {name}d AS (SELECT d, {_mixed_sql('d', 'm')} FROM (SELECT unnest(generate_series((SELECT min(lo) FROM {name}l), (SELECT max(hi) FROM {name}l))) AS d)),"
        f" {name}n AS (SELECT {key}, phi, lo, sim, d, {_mixed_sql('xor(own, m)', 'u')}, {_mixed_sql(f'xor(u, {noise.OTHER})', 'v')}, sqrt(-2 * ln((u + 0.5) / 4294967296.0::DOUBLE)) * cos({PI2} * ((v + 0.5) / 4294967296.0::DOUBLE)) AS e FROM {name}s JOIN {name}d ON d BETWEEN lo AND hi),"
        f" {name}w AS (SELECT {key}, phi, sim, d, (d - lo) // {_BLOCK} AS bl, (d - lo) % {_BLOCK} AS k, CASE WHEN d = lo THEN {first} ELSE sqrt(greatest(1e-12, 1 - phi * phi)) * e END AS w FROM {name}n),"
        f" {name}z AS (SELECT {key}, phi, sim, d, bl, k, w + {lags} AS z FROM {name}w WINDOW b AS (PARTITION BY {key}, sim, bl ORDER BY k)),"
        f" {name}e AS (SELECT {key}, phi, sim, bl, z FROM {name}z WHERE k = {_BLOCK - 1}),"
        f" {name}c AS (SELECT a.{key}, a.sim, a.bl + 1 AS bl, sum(pow(a.phi, {_BLOCK} * (a.bl - b.bl)) * b.z) AS carry FROM {name}e a JOIN {name}e b ON a.{key} = b.{key} AND a.sim = b.sim AND b.bl <= a.bl GROUP BY ALL),"
        f" {name}v AS (SELECT z.{key}, z.sim, z.d, z + pow(phi, k + 1) * coalesce(carry, 0) AS value FROM {name}z z LEFT JOIN {name}c c ON z.{key} = c.{key} AND z.sim = c.sim AND z.bl = c.bl),"
        f" {name} AS (SELECT v.{key}, v.sim, y.date, v.value FROM {name}v v JOIN {days} y ON v.{key} = y.{key} AND v.d = {at.replace('date)', 'y.date)')})"
    )


_SUMMARY = "SELECT o.{k}, 'ok' AS status, round(o.s, 7) AS observed, round(o.at, 7) AS observed_at, round((count(CASE WHEN n.s >= o.s THEN 1 END) + 1) / (count(n.s) + 1)::DOUBLE, 7) AS p_value, count(CASE WHEN n.s >= o.s THEN 1 END) AS exceedances, count(n.s) AS used, round(quantile_cont(n.s, 0.95), 7) AS null_q95, round(quantile_cont(n.s, 0.99), 7) AS null_q99 FROM OB o LEFT JOIN NU n ON o.{k} = n.{k} GROUP BY o.{k}, o.s, o.at"
_RAWZ = ", {n} AS (SELECT sim, date, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS z FROM {src} WINDOW w AS (PARTITION BY sim))"


def _band_max_sql(src: str, name: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f", {name} AS (SELECT {k}band, max(dcf) AS s, arg_max(lag_bin_center, dcf) AS at FROM {src} JOIN ({bands_sql()}) ON lag_bin_center BETWEEN lo AND hi WHERE pairs >= {LEAST} GROUP BY ALL)"


def _suffixed(sql: str, suffix: str) -> str:
    import re

    return re.sub(r"\b(K|DK|D0|D|D1|DB)\b(?! BY)", lambda m: m[1] + suffix, sql)


_SIMS = 499
_AK = "AK AS (SELECT 'a' AS side, date, value FROM A)"
_DAYS = _day_phi_sql("AK", "log10(value)", "side") + ", DY AS (SELECT side, date, phi FROM AK JOIN PH USING (side) WHERE value > 0)"
_COLUMNS = ["status", "observed", "observed_at", "p_value", "exceedances", "used", "null_q95", "null_q99"]


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series A as log10 of its positive values, side a."""
    return written(series.transformed(inputs.pair(spark, sf_dir)[0].withColumn("side", F.lit("a")), "log10"))


@query(with_("O", "A", _AK) + _DAYS + noise_sql("DY", "side", _SIMS) + _RAWZ.format(n="ZN", src="NZ") + dcf_sql("ZN", "ZN", LO, HI, "sim") + _band_max_sql("DB", "NU", "sim") + z_sql("ZA", "A") + _suffixed(dcf_sql("ZA", "ZA", LO, HI), "_o") + _band_max_sql("DB_o", "OB") + " " + _SUMMARY.format(k="band"))
def ar1_dcf_null_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band maxima of the autocorrelation DCF of A against red noise on its observed days."""
    return tidy(nulls.ar1_dcf_null(_logs(spark, sf_dir), ["side"], BANDS, _SIMS, seed=SEED).where("observed IS NOT NULL").select("band", *_COLUMNS))


def _top_sql(src: str, name: str, keys: str) -> str:
    return f", {name} AS (SELECT {keys}, max(power) AS s, arg_max(period_days, power) AS at FROM {src} GROUP BY ALL)"


_NP = 96


@query(with_("O", "A", _AK) + _DAYS + noise_sql("DY", "side", _SIMS) + prepared_sql("NZ", "sim", "none", name="N0") + lomb_sql(_periods(430, 520, _NP), "sim", least=30, src="N0", name="NL") + prepared_sql("AK", "side", "none", True) + lomb_sql(_periods(430, 520, _NP), "side", least=30) + _top_sql("NL", "NU", "'a' AS side, sim") + _top_sql("LS", "OB", "side") + " " + _SUMMARY.format(k="side"))
def ar1_spectral_null_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest power of A in the band against red noise on its observed days."""
    return tidy(nulls.ar1_spectral_null(_logs(spark, sf_dir), ["side"], (430, 520), _SIMS, periods=_NP, seed=SEED).select("side", *_COLUMNS))


_ROW_PHI = ", FLi AS (SELECT side, date, y, lead(y) OVER (PARTITION BY side ORDER BY date) AS z, row_number() OVER (PARTITION BY side ORDER BY date) - 1 AS i FROM FL), FP AS (SELECT side, coalesce(greatest(-0.98, least(0.98, sum(y * z) / nullif(sum(CASE WHEN z IS NOT NULL THEN y * y END), 0))), 0) AS phi FROM FLi GROUP BY 1), RD AS (SELECT side, i AS date, phi FROM FLi JOIN FP USING (side))"
_FLAT = ", FL0 AS (SELECT side, date, date_diff('day', DATE '1970-01-01', date) - avg(date_diff('day', DATE '1970-01-01', date)) OVER w AS t, value - avg(value) OVER w AS y FROM AK WHERE value IS NOT NULL WINDOW w AS (PARTITION BY side)), FL AS (SELECT side, date, y - sum(y * t) OVER w / sum(t * t) OVER w * t AS y FROM FL0 WINDOW w AS (PARTITION BY side))"


@query(with_("O", "A", _AK) + _FLAT + _ROW_PHI + noise_sql("RD", "side", _SIMS, stationary=False, at="(date)") + ", RN AS (SELECT n.sim, f.date, n.value FROM NZ n JOIN FLi f ON n.side = f.side AND n.date = f.i)" + prepared_sql("RN", "sim", "none", name="N0") + lomb_sql(_freqs(430, 520, _NP), "sim", least=30, src="N0", name="NL") + prepared_sql("AK", "side") + lomb_sql(_freqs(430, 520, _NP), "side", least=30) + _top_sql("NL", "NU", "'a' AS side, sim") + _top_sql("LS", "OB", "side") + " " + _SUMMARY.format(k="side"))
def red_noise_null_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest power of A in the band against red noise by position that starts from 0."""
    rows = inputs.pair(spark, sf_dir)[0].withColumn("side", F.lit("a"))
    return tidy(nulls.red_noise_null(rows, ["side"], (430, 520), _SIMS, _NP, SEED).select("side", *_COLUMNS))


_JSIMS, _JYEARS, _JLEAST = 99, 3, 60
_JW = f", WE AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(date) AS lo, max(date) AS hi FROM AB0 WHERE value > 0 GROUP BY side)), AB AS (SELECT AB0.* FROM AB0, WE WHERE date BETWEEN lo AND hi AND value > 0), W AS (SELECT k AS w, CAST(lo + to_years(CAST(k AS INT)) AS DATE) AS window_start, CAST(lo + to_years(CAST(k + {_JYEARS} AS INT)) - INTERVAL 1 DAY AS DATE) AS window_stop FROM WE, (SELECT unnest(generate_series(0, 50)) AS k) WHERE lo + to_years(CAST(k + {_JYEARS} AS INT)) - INTERVAL 1 DAY <= hi)"


def _joint_sql(src: str, name: str) -> str:
    """CTEs name (w, sim, period_days, a, b, joint) and its maxima name || 'm', of spectra src keyed by side|sim|w."""
    pairs = f", {name}j AS (SELECT p.sim, p.w, p.period_days, p.power AS a, q.power AS b, sqrt(greatest(p.power, 0) * greatest(q.power, 0)) AS joint FROM {name}s p JOIN {name}s q ON p.side = 'a' AND q.side = 'b' AND p.sim = q.sim AND p.w = q.w AND abs(p.period_days - q.period_days) < 1e-6)"
    tops = " UNION ALL ".join(f"SELECT '{c}' AS band, sim, max({c}) AS s, arg_max(period_days, {c}) AS at FROM {name}j GROUP BY sim" for c in ("a", "b", "joint"))
    return f", {name}s AS (SELECT split_part(sw, '|', 1) AS side, split_part(sw, '|', 2) AS sim, split_part(sw, '|', 3) AS w, period_days, power FROM {src})" + pairs + f", {name} AS ({tops})"


@query(with_("O", "A", "B", "AB0 AS (SELECT 'a' AS side, date, value FROM A UNION ALL SELECT 'b', date, value FROM B)") + _JW + _day_phi_sql("AB", "log10(value)", "side") + ", DY AS (SELECT side, date, phi FROM AB JOIN PH USING (side))" + noise_sql("DY", "side", _JSIMS, text="'ab|' || side") + ", NW AS (SELECT side || '|' || sim || '|' || w AS sw, date, value FROM NZ JOIN W ON date BETWEEN window_start AND window_stop)" + prepared_sql("NW", "sw", "linear", name="N0") + lomb_sql(_periods(430, 520, _NP), "sw", least=_JLEAST, src="N0", name="NL") + ", OW AS (SELECT side || '|0|' || w AS sw, date, value FROM AB JOIN W ON date BETWEEN window_start AND window_stop)" + prepared_sql("OW", "sw", "linear", True) + lomb_sql(_periods(430, 520, _NP), "sw", least=_JLEAST) + _joint_sql("NL", "NU") + _joint_sql("LS", "OB") + " " + _SUMMARY.format(k="band"))
def joint_null_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest power of A, B and both over windows and periods against independent red noise."""
    got = nulls.joint_null(_sides(spark, sf_dir), ["pair"], (430, 520), _JSIMS, "linear", _NP, _JYEARS, 1, _JLEAST, SEED)
    return tidy(got.select("band", *_COLUMNS))


_MARGIN = 700
_ROLLED = with_("O", "A", "B") + lag_queries._CS + ", N AS (SELECT lo, date_diff('day', lo, hi) + 1 AS n FROM SP), {draws}LA AS (SELECT date, log10(value) AS v FROM CA WHERE value > 0), LB AS (SELECT date, log10(value) AS v FROM CB WHERE value > 0), Z1 AS (SELECT date, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM LA), Z2 AS (SELECT date, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM LB), ZN AS (SELECT sim, lo + CAST((date_diff('day', lo, date) + sim) % n AS INT) AS date, z FROM Z2, N, SH), ZM AS (SELECT sim, date, z FROM Z1, SH)" + dcf_sql("ZM", "ZN", LO, HI, "sim") + _band_max_sql("DB", "ND", "sim") + _suffixed(dcf_sql("Z1", "Z2", LO, HI), "_o") + _band_max_sql("DB_o", "OB")
_EACH = f"SH AS (SELECT unnest(generate_series({_MARGIN}, n - {_MARGIN})) AS sim FROM N), "
_DRAWN = f"DW AS (SELECT sim, {_mixed_sql(_stream_sql(chr(39) + 'ab' + chr(39)), 'g')}, {_mixed_sql('sim', 'h')}, {_mixed_sql('xor(g, h)', 'own')}, {_mixed_sql('own', 'u')}, {_MARGIN} + CAST(floor((u + 0.5) / 4294967296.0::DOUBLE * (n - {2 * _MARGIN} + 1)) AS BIGINT) AS shift FROM (SELECT unnest(generate_series(0, {_SIMS - 1})) AS sim), N WHERE n >= {2 * _MARGIN + 1}), SH AS (SELECT DISTINCT shift AS sim FROM DW), "


@query(_ROLLED.replace("{draws}", _EACH) + ", NU AS (SELECT * FROM ND) " + _SUMMARY.format(k="band"))
def circular_shift_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band maxima of the cross DCF against B rolled around the common span by every allowed shift."""
    return tidy(nulls.circular_shift_null(_sides(spark, sf_dir), ["pair"], BANDS, None).select("band", *_COLUMNS))


@query()
def ar1_null_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random AR(1) test of the DCF band maxima of every channel."""
    return tidy(nulls.ar1_dcf_null(written(series.transformed(inputs.orders(spark, sf_dir), "log10")), ["channel"], BANDS))


@query()
def ar1_spectral_null_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random AR(1) test of every channel's largest power in the band."""
    return tidy(nulls.ar1_spectral_null(written(series.transformed(inputs.orders(spark, sf_dir), "log10")), ["channel"], (430, 520)))


@query()
def red_noise_band_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(nulls.red_noise_null(written(inputs.orders(spark, sf_dir)), ["channel"], (430, 520)))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (series.transformed(x, "log10") for x in inputs.pair(spark, sf_dir))
    return written(a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))).withColumn("pair", F.lit("ab")))


@query(_ROLLED.replace("{draws}", _DRAWN) + ", NU AS (SELECT DW.sim, band, s FROM DW JOIN ND ON ND.sim = shift) " + _SUMMARY.format(k="band").replace("SELECT o.", "SELECT 'ab' AS pair, o.", 1))
def circular_shift_null_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band maxima of the cross DCF against shifts drawn with replacement."""
    return tidy(nulls.circular_shift_null(_sides(spark, sf_dir), ["pair"], BANDS, seed=SEED))


@query()
def joint_null_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest power of A, B and both over calendar windows against seeded random AR(1) noise."""
    return tidy(nulls.joint_null(_sides(spark, sf_dir), ["pair"], (430, 520), years=4, step=1))
