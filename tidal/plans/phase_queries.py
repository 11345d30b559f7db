"""Phases that build on one another: tests, their review, and work driven by its candidates."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lagcorr, nulls, peaks, phases, review, series
from ..sources import sinks, text
from ..sources.phase_store import PhaseStore
from ..sources.store import shared_folder, written
from . import inference_queries, inputs, spectral_queries
from .inputs import BANDS
from .lag_queries import HI, LEAST, LO, WIDTH, bands_sql, dcf_sql, prominence_sql, windows, z_sql
from .lag_queries import _windows_sql as windows_sql
from .registry import query, tidy
from .series_queries import runs_sql

SIMULATIONS = 499


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, side, date, value): revenue of small and large lines by return flag."""
    rows = inputs.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("channel"), F.when(F.col("l_quantity") > 25, "a").otherwise("b").alias("side"), F.to_date("l_shipdate").alias("date")
    ).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("value"))
    return written(rows)


_SD = "SD AS (SELECT l_returnflag AS channel, CASE WHEN l_quantity > 25 THEN 'a' ELSE 'b' END AS side, CAST(l_shipdate AS DATE) AS date, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem GROUP BY ALL)"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, variant, side, date, value): logarithms of _rows, plain and without their line."""
    return written(phases.variants(_rows(spark, sf_dir), ["channel", "side"]).select("channel", "variant", "side", "date", "value"))


def significance(rows: DataFrame, bands: dict[str, tuple[int, int]], simulations: int) -> DataFrame:
    """Red-noise tests of each side and shift tests of both, adjusted over channels: (channel, band, variant, branch, status, observed_at, observed, p, p_holm, q_bh)."""
    keys = ["channel", "variant"]
    own = nulls.ar1_dcf_null(rows, [*keys, "side"], bands, simulations).withColumn("branch", F.concat(F.lit("acf_"), "side")).withColumnRenamed("p_value", "p_ar1").drop("side")
    cross = nulls.circular_shift_null(rows, keys, bands, simulations).withColumn("branch", F.lit("ccf")).withColumnRenamed("p_value", "p_shift")
    tests = own.unionByName(cross, allowMissingColumns=True).withColumn("p", review.branch_p())
    return review.adjusted_by_branch(tests).select("channel", "band", "variant", "branch", "status", *review.COLUMNS)


@query()
def phase_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of all channels, variants and branches with random nulls."""
    return tidy(significance(_sides(spark, sf_dir), BANDS, SIMULATIONS))


@query()
def phase_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review of phase_significance, read back from its run in a phase store."""
    store = PhaseStore(spark, f"{shared_folder(spark)}/phases-{uuid.uuid4().hex}")
    run = store.write("significance", significance(_sides(spark, sf_dir), BANDS, SIMULATIONS), {"simulations": SIMULATIONS})
    return tidy(review.by_branch(store.read(run), ["channel", "band"], SIMULATIONS, members=3, affected=("R",)))


# the same with fewer simulations, which SQL can draw in a short time

_FEW = 9


def _test_sql(simulations: int) -> str:
    """CTEs TS (channel, band, variant, branch, lag, s, p) and TA, with p_holm and q_bh: the tests of phase_significance."""
    z = "coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z"
    count = "(count(CASE WHEN n.s >= o.s THEN 1 END) + 1) / (count(n.s) + 1)::DOUBLE AS p"
    noise, mixed = inference_queries.noise_sql, inference_queries._mixed_sql
    margin = inference_queries._MARGIN
    top, suffixed = inference_queries._band_max_sql, inference_queries._suffixed
    return "WITH RECURSIVE " + _SD + (
        ", VB0 AS (SELECT channel, side, date, log10(value) AS v, date_diff('day', DATE '1970-01-01', date) AS t FROM SD WHERE value > 0),"
        " VB1 AS (SELECT *, v - avg(v) OVER w AS y, t - avg(t) OVER w AS u FROM VB0 WINDOW w AS (PARTITION BY channel, side)),"
        " VB AS (SELECT channel, side, 'raw' AS variant, date, v FROM VB0 UNION ALL SELECT channel, side, 'detrended', date, y - sum(y * u) OVER w / sum(u * u) OVER w * u FROM VB1 WINDOW w AS (PARTITION BY channel, side)),"
        " VK AS (SELECT channel || '|' || variant || '|' || side AS ck, channel || '|' || variant AS cv, side, date, v, 1 AS value FROM VB)"
        + inference_queries._day_phi_sql("VK", "v", "ck") + ", DY AS (SELECT ck, date, phi FROM VK JOIN PH USING (ck))" + noise("DY", "ck", simulations)
        + f", ZN AS (SELECT cs, date, {z} FROM (SELECT ck || '#' || sim AS cs, date, value AS v FROM NZ) WINDOW w AS (PARTITION BY cs))" + dcf_sql("ZN", "ZN", LO, HI, "cs") + top("DB", "NA0", "cs")
        + f", NA AS (SELECT split_part(cs, '#', 1) AS ck, band, s FROM NA0), ZO AS (SELECT ck, date, {z} FROM VK WINDOW w AS (PARTITION BY ck))" + suffixed(dcf_sql("ZO", "ZO", LO, HI, "ck"), "_o") + top("DB_o", "OA", "ck")
        + ", SPX AS (SELECT cv, max(lo) AS lo, min(hi) AS hi FROM (SELECT cv, side, min(date) AS lo, max(date) AS hi FROM VK GROUP BY ALL) GROUP BY ALL), SPN AS (SELECT *, date_diff('day', lo, hi) + 1 AS n FROM SPX)"
        + f", ZC AS (SELECT cv, side, date, n, lo, {z} FROM VK JOIN SPN USING (cv) WHERE date BETWEEN lo AND hi WINDOW w AS (PARTITION BY cv, side)), ZCA AS (SELECT cv, date, z FROM ZC WHERE side = 'a'), ZCB AS (SELECT cv, date, z FROM ZC WHERE side = 'b')"
        + f", DW AS (SELECT cv, sim, {mixed(inference_queries._stream_sql('cv'), 'g')}, {mixed('sim', 'h')}, {mixed('xor(g, h)', 'own')}, {mixed('own', 'u')}, {margin} + CAST(floor((u + 0.5) / 4294967296.0::DOUBLE * (n - {2 * margin} + 1)) AS BIGINT) AS shift FROM (SELECT unnest(generate_series(0, {simulations - 1})) AS sim), SPN WHERE n >= {2 * margin + 1})"
        + ", SH AS (SELECT DISTINCT cv, shift FROM DW), RA AS (SELECT ZCA.cv || '#' || shift AS cs, date, z FROM ZCA JOIN SH USING (cv)), RB AS (SELECT ZC.cv || '#' || shift AS cs, lo + CAST((date_diff('day', lo, date) + shift) % n AS INT) AS date, z FROM ZC JOIN SH USING (cv) WHERE side = 'b')"
        + suffixed(dcf_sql("RA", "RB", LO, HI, "cs"), "_r") + top("DB_r", "NR0", "cs") + ", NR AS (SELECT DW.cv, band, s FROM DW JOIN NR0 ON NR0.cs = DW.cv || '#' || shift)"
        + suffixed(dcf_sql("ZCA", "ZCB", LO, HI, "cv"), "_x") + top("DB_x", "OX", "cv")
        + f", TS AS (SELECT split_part(o.ck, '|', 1) AS channel, band, split_part(o.ck, '|', 2) AS variant, 'acf_' || split_part(o.ck, '|', 3) AS branch, o.at AS lag, o.s, {count} FROM OA o LEFT JOIN NA n USING (ck, band) GROUP BY ALL"
        + f" UNION ALL SELECT split_part(o.cv, '|', 1), band, split_part(o.cv, '|', 2), 'ccf', o.at, o.s, {count} FROM OX o LEFT JOIN NR n USING (cv, band) GROUP BY ALL)"
        + ", TR AS (SELECT *, row_number() OVER f AS i, count(*) OVER (PARTITION BY band, variant, branch) AS m FROM TS WINDOW f AS (PARTITION BY band, variant, branch ORDER BY p, channel))"
        + ", TA AS (SELECT * EXCLUDE (i, m), max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY band, variant, branch ORDER BY i) AS p_holm, min(least(1.0, m * p / i)) OVER (PARTITION BY band, variant, branch ORDER BY i DESC) AS q_bh FROM TR)"
    )


def _wide_sql(variants: dict[str, str], columns: tuple[str, ...]) -> str:
    return ", ".join(f"round(max(CASE WHEN variant = {n} AND branch = '{b}' THEN {c} END), 7) AS {v}_{b}_{f}" for v, n in variants.items() for b in review.BRANCHES for c, f in zip(columns, review.FIELDS))


def _flags_sql(simulations: int, members: int, limited: str) -> str:
    floor = f"{simulations + 1}.0::DOUBLE"
    return (
        "coalesce(raw_ccf_fdr < 0.05, false) AS raw_significant, coalesce(detrended_ccf_fdr < 0.05, false) AS detrended_significant, coalesce(raw_ccf_fdr < 0.05, false) AND coalesce(detrended_ccf_fdr < 0.05, false) AS robust,"
        f" coalesce(abs(raw_ccf_p - 1 / {floor}) < 1e-12, false) AS raw_at_floor, coalesce(abs(detrended_ccf_p - 1 / {floor}) < 1e-12, false) AS detrended_at_floor, round(1 / {floor}, 7) AS p_floor, round({members} / {floor}, 7) AS holm_floor, {limited} AS quality_limited"
    )


@query(_test_sql(_FEW) + f", BW AS (SELECT channel, band, {_wide_sql({v: repr(v) for v in review.VARIANTS}, ('lag', 's', 'p', 'p_holm', 'q_bh'))} FROM TA GROUP BY 1, 2) SELECT *, {_flags_sql(_FEW, 3, chr(39).join(['channel = ', 'R', '']))} FROM BW")
def significance_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of all channels, variants and branches, written as a run of a phase store and reviewed from there."""
    store = PhaseStore(spark, f"{shared_folder(spark)}/phases-{uuid.uuid4().hex}")
    run = store.write("significance", significance(_sides(spark, sf_dir), BANDS, _FEW), {"simulations": _FEW})
    return tidy(review.by_branch(store.read(run), ["channel", "band"], _FEW, members=3, affected=("R",)))


# candidates that are fixed before their tests run

_LOCKED = (("R", "long", "primary"), ("A", "long", "comparator"))
_SPECTRAL, _JOINT, _YEARS, _USED = 99, 49, 3, 180
_CANDIDATES = "CN AS (SELECT * FROM (VALUES " + ", ".join(map(str, _LOCKED)) + ") v(channel, band, role))"
_DETREND = {"raw": "none", "detrended": "linear"}
_P = "(count(CASE WHEN n.s >= o.s THEN 1 END) + 1) / (count(n.s) + 1)::DOUBLE AS p_value, count(CASE WHEN n.s >= o.s THEN 1 END) AS exceedances, count(n.s) AS used, quantile_cont(n.s, 0.95) AS null_q95, quantile_cont(n.s, 0.99) AS null_q99"
_ROUNDED = "round(observed, 7) AS observed, round(observed_at, 7) AS observed_at, round(p_value, 7) AS p_value, exceedances, used, round(null_q95, 7) AS null_q95, round(null_q99, 7) AS null_q99, round(p_holm, 7) AS p_holm, round(q_bh, 7) AS q_bh"


def _locked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LOCKED, "channel string, band string, role string")


def _family_sql(src: str, name: str, order: str) -> str:
    """CTE name: src with p_holm and q_bh over each variant."""
    return (
        f", {name}r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY p_value, {order}) AS i, count(*) OVER (PARTITION BY variant) AS m FROM {src}),"
        f" {name} AS (SELECT * EXCLUDE (i, m), max(least(1.0, (m - i + 1) * p_value)) OVER (PARTITION BY variant ORDER BY i) AS p_holm, min(least(1.0, m * p_value / i)) OVER (PARTITION BY variant ORDER BY i DESC) AS q_bh FROM {name}r)"
    )


def _spectra_sql(null: str, own: str, null_key: str, own_key: str, least: int) -> str:
    """CTEs NL_raw, NL_detrended, LS_raw and LS_detrended: spectra in the band of surrogates (values) and series (logarithms)."""
    grid = spectral_queries._periods(430, 520, 96)
    sources = [(null, null_key, False, "NL", "N"), (own, own_key, True, "LS", "P")]
    return "".join(spectral_queries.prepared_sql(src, key, d, log10, f"{prep}_{v}") + spectral_queries.lomb_sql(grid, key, least=least, src=f"{prep}_{v}", name=f"{name}_{v}") for src, key, log10, name, prep in sources for v, d in _DETREND.items())


_B9 = "WITH RECURSIVE " + _SD + ", " + _CANDIDATES + ", CK AS (SELECT channel || '|' || side AS ck, date, value FROM SD SEMI JOIN CN USING (channel))" + inference_queries._day_phi_sql("CK", "log10(value)", "ck") + ", DY AS (SELECT ck, date, phi FROM CK JOIN PH USING (ck) WHERE value > 0)" + inference_queries.noise_sql("DY", "ck", _SPECTRAL) + ", NK AS (SELECT ck || '#' || sim AS sk, date, value FROM NZ)" + _spectra_sql("NK", "CK", "sk", "ck", 30) + ", ".join(
    ["", "OB AS (" + " UNION ALL ".join(f"SELECT ck, '{v}' AS variant, max(power) AS s, arg_max(period_days, power) AS at FROM LS_{v} GROUP BY ck" for v in _DETREND) + ")",
     "NU AS (" + " UNION ALL ".join(f"SELECT split_part(sk, '#', 1) AS ck, '{v}' AS variant, max(power) AS s FROM NL_{v} GROUP BY sk" for v in _DETREND) + ")",
     f"TT AS (SELECT split_part(o.ck, '|', 1) AS channel, split_part(o.ck, '|', 2) AS side, o.variant, o.s AS observed, o.at AS observed_at, {_P} FROM OB o LEFT JOIN NU n USING (ck, variant) GROUP BY ALL)"]
) + _family_sql("TT", "TF", "channel, side")


@query(_B9 + f" SELECT channel, band, role, side, variant, 'ok' AS status, {_ROUNDED} FROM CN JOIN TF USING (channel)")
def locked_spectral_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red-noise tests of the largest power of both sides of every locked candidate, adjusted over the four tests of a variant."""
    return tidy(phases.locked_spectral(_rows(spark, sf_dir), _locked(spark), (430, 520), _SPECTRAL))


@query()
def locked_spectral_tests_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 1999 simulations."""
    return tidy(phases.locked_spectral(_rows(spark, sf_dir), _locked(spark), (430, 520)))


_B10 = "WITH RECURSIVE " + _SD + ", " + _CANDIDATES + (
    ", WE AS (SELECT channel, max(lo) AS lo, min(hi) AS hi FROM (SELECT channel, side, min(date) AS lo, max(date) AS hi FROM SD SEMI JOIN CN USING (channel) WHERE value > 0 GROUP BY ALL) GROUP BY ALL),"
    " CK AS (SELECT channel || '|' || side AS ck, channel, date, value FROM SD JOIN WE USING (channel) WHERE date BETWEEN lo AND hi AND value > 0),"
    f" W AS (SELECT channel, k AS w, CAST(lo + to_years(CAST(k AS INT)) AS DATE) AS window_start, CAST(lo + to_years(CAST(k + {_YEARS} AS INT)) - INTERVAL 1 DAY AS DATE) AS window_stop FROM WE, (SELECT unnest(generate_series(0, 50)) AS k) WHERE lo + to_years(CAST(k + {_YEARS} AS INT)) - INTERVAL 1 DAY <= hi)"
    + inference_queries._day_phi_sql("CK", "log10(value)", "ck") + ", DY AS (SELECT ck, date, phi FROM CK JOIN PH USING (ck))" + inference_queries.noise_sql("DY", "ck", _JOINT)
    + ", NK AS (SELECT ck || '#' || sim || '#' || w AS sk, date, value FROM NZ JOIN W ON W.channel = split_part(ck, '|', 1) AND date BETWEEN window_start AND window_stop), OK AS (SELECT ck || '#0#' || w AS sk, date, value FROM CK JOIN W ON W.channel = CK.channel AND date BETWEEN window_start AND window_stop)"
    + _spectra_sql("NK", "OK", "sk", "sk", _USED)
)


def _joined_sql(name: str) -> str:
    """CTE name || 'J': largest power of a, b and both by channel, variant and simulation, of spectra name || variant."""
    each = " UNION ALL ".join(f"SELECT '{v}' AS variant, split_part(split_part(sk, '#', 1), '|', 1) AS channel, split_part(split_part(sk, '#', 1), '|', 2) AS side, split_part(sk, '#', 2) AS sim, CAST(split_part(sk, '#', 3) AS BIGINT) AS w, round(period_days, 6) AS k, period_days, power FROM {name}_{v}" for v in _DETREND)
    both = f", {name}E AS ({each}), {name}B AS (SELECT p.variant, p.channel, p.sim, p.w, p.period_days, p.power AS a, q.power AS b, sqrt(greatest(p.power, 0) * greatest(q.power, 0)) AS joint FROM {name}E p JOIN {name}E q ON p.side = 'a' AND q.side = 'b' AND p.variant = q.variant AND p.channel = q.channel AND p.sim = q.sim AND p.w = q.w AND p.k = q.k)"
    return both + f", {name}J AS (" + " UNION ALL ".join(f"SELECT variant, channel, sim, '{c}' AS statistic, max({c}) AS s, arg_max(period_days, {c}) AS at, arg_max(w, {c}) AS w FROM {name}B GROUP BY ALL" for c in ("a", "b", "joint")) + ")"


_B10 += _joined_sql("NL") + _joined_sql("LS") + f", TT AS (SELECT o.channel, o.variant, o.statistic, o.s AS observed, o.at AS observed_at, o.w, {_P} FROM LSJ o LEFT JOIN NLJ n USING (channel, variant, statistic) GROUP BY ALL), TJ AS (SELECT * FROM TT WHERE statistic = 'joint')" + _family_sql("TJ", "TF0", "channel") + ", TF AS (SELECT * FROM TF0 UNION ALL SELECT *, NULL, NULL FROM TT WHERE statistic <> 'joint')"


@query(_B10 + f" SELECT TF.channel, band, role, variant, statistic, 'ok' AS status, window_start, window_stop, {_ROUNDED} FROM CN JOIN TF USING (channel) JOIN W ON W.channel = TF.channel AND W.w = TF.w")
def locked_joint_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of the largest power at one period in one window for both sides of every locked candidate; the joint ones of a variant are a family."""
    return tidy(phases.locked_joint(_rows(spark, sf_dir), _locked(spark), (430, 520), _JOINT, years=_YEARS, step=1, least=_USED))


@query()
def locked_joint_tests_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with 1999 simulations."""
    return tidy(phases.locked_joint(_rows(spark, sf_dir), _locked(spark), (430, 520), years=_YEARS, step=1, least=_USED))


# screening of both sides

_SCREEN_N = 3500
_BEST = "(SELECT *, row_number() OVER (PARTITION BY {k}, band ORDER BY dcf DESC, lag_bin_center) AS r FROM {src} JOIN (" + bands_sql() + f") ON lag_bin_center BETWEEN lo AND hi WHERE pairs >= {LEAST} AND dcf IS NOT NULL)"
_SCREEN = "WITH RECURSIVE " + _SD + ", SK AS (SELECT channel || '|' || side AS ck, date, value FROM SD)" + z_sql("ZS", "SK", "ck") + dcf_sql("ZS", "ZS", LO, HI, "ck") + ", ZA AS (SELECT split_part(ck, '|', 1) AS channel, date, z FROM ZS WHERE ck LIKE '%|a'), ZB AS (SELECT split_part(ck, '|', 1) AS channel, date, z FROM ZS WHERE ck LIKE '%|b')" + inference_queries._suffixed(dcf_sql("ZA", "ZB", LO, HI, "channel"), "_x") + (
    spectral_queries.prepared_sql("SK", "ck", log10=True) + spectral_queries.lomb_sql(spectral_queries._freqs(LO, HI, _SCREEN_N), "ck", True) + spectral_queries.best_sql("LS", "BS", "ck") + spectral_queries.window_sql("SK", LO, HI, "ck") + spectral_queries.best_sql("SW", "BW", "ck")
) + f", BD AS (SELECT split_part(ck, '|', 1) AS channel, 'acf_' || split_part(ck, '|', 2) AS branch, band, lag_bin_center AS lag, dcf FROM {_BEST.format(k='ck', src='DB')} WHERE r = 1 UNION ALL SELECT channel, 'ccf', band, lag_bin_center, dcf FROM {_BEST.format(k='channel', src='DB_x')} WHERE r = 1)" + (
    ", FR AS (SELECT channel, band, count(CASE WHEN side = 'a' THEN value END) AS n_a, count(CASE WHEN side = 'b' THEN value END) AS n_b FROM SD, (" + bands_sql() + ") GROUP BY ALL), D2 AS (SELECT channel, band, "
    + ", ".join(f"max(CASE WHEN branch = '{b}' THEN {c} END) AS {c}_{b}" for b in review.BRANCHES for c in ("lag", "dcf")) + " FROM BD GROUP BY ALL), S2 AS (SELECT split_part(BS.ck, '|', 1) AS channel, BS.band, "
    + ", ".join(f"max(CASE WHEN BS.ck LIKE '%|{s}' THEN {c} END) AS {n}_{s}" for s in "ab" for c, n in (("BS.period_days", "gls_period"), ("BS.power", "gls_power"), ("BW.period_days", "window_period"))) + " FROM BS FULL JOIN BW ON BS.ck = BW.ck AND BS.band = BW.band GROUP BY ALL)"
)


@query(_SCREEN + " SELECT channel, band, n_a, n_b, " + ", ".join(f"round({c}, 7) AS {c}" for c in [f"{c}_{b}" for b in review.BRANCHES for c in ("lag", "dcf")] + [f"{n}_{s}" for s in "ab" for n in ("gls_period", "gls_power", "window_period")]) + ", " + ", ".join(f"round(gls_period_{s} - window_period_{s}, 7) AS gls_minus_window_{s}" for s in "ab") + ", round(greatest(dcf_acf_a, dcf_acf_b, dcf_ccf), 7) AS screen_score, row_number() OVER (PARTITION BY band ORDER BY greatest(dcf_acf_a, dcf_acf_b, dcf_ccf) DESC NULLS LAST, channel) AS rank FROM FR LEFT JOIN D2 USING (channel, band) LEFT JOIN S2 USING (channel, band)")
def screening_of_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three DCFs, two spectra and two sampling windows of every channel and band, ranked by the largest coefficient."""
    return tidy(phases.screening(_rows(spark, sf_dir), BANDS, LO, HI, WIDTH, _SCREEN_N, LEAST))


# what the tests lead to: windows of the candidates, and an atlas beside the tests

#: Lax, as so few simulations can't give less than 0.1.
_LEVEL = 0.35


def _tested(spark: SparkSession, sf_dir: str) -> tuple[PhaseStore, str]:
    """A phase store with a run of the tests, and the run's name."""
    store = PhaseStore(spark, f"{shared_folder(spark)}/phases-{uuid.uuid4().hex}")
    return store, store.write("significance", significance(_sides(spark, sf_dir), BANDS, _FEW), {"simulations": _FEW})


_TESTS = "(SELECT * FROM (" + _test_sql(_FEW) + " SELECT * FROM TA))"
_LOCAL = "WITH RECURSIVE " + _SD + f", PT AS {_TESTS}, CD AS (SELECT DISTINCT channel, band FROM PT WHERE q_bh < {_LEVEL})" + (
    ", WE AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT channel, side, min(date) AS lo, max(date) AS hi FROM SD GROUP BY ALL)), WN AS (SELECT lo AS ws FROM WE UNION ALL SELECT CAST(ws + INTERVAL 1 YEAR AS DATE) FROM WN, WE WHERE ws < hi),"
    " W AS (SELECT ws AS window_start, CAST(ws + to_years(3) - INTERVAL 1 DAY AS DATE) AS window_stop FROM WN, WE WHERE ws + to_years(3) - INTERVAL 1 DAY <= hi),"
    " LW AS (SELECT channel || '|' || window_start AS cw, side, date, value FROM SD JOIN W ON date BETWEEN window_start AND window_stop WHERE channel IN (SELECT channel FROM CD)), LS_ AS (SELECT cw || '|' || side AS ck, date, value FROM LW)"
) + z_sql("ZS", "LS_", "ck") + dcf_sql("ZS", "ZS", LO, HI, "ck") + ", ZA AS (SELECT left(ck, length(ck) - 2) AS cw, date, z FROM ZS WHERE ck LIKE '%|a'), ZB AS (SELECT left(ck, length(ck) - 2) AS cw, date, z FROM ZS WHERE ck LIKE '%|b')" + inference_queries._suffixed(dcf_sql("ZA", "ZB", LO, HI, "cw"), "_x") + (
    ", LB AS (SELECT split_part(ck, '|', 1) AS channel, CAST(split_part(ck, '|', 2) AS DATE) AS window_start, 'acf_' || split_part(ck, '|', 3) AS branch, lag_bin_center, dcf, pairs FROM DB UNION ALL SELECT split_part(cw, '|', 1), CAST(split_part(cw, '|', 2) AS DATE), 'ccf', lag_bin_center, dcf, pairs FROM DB_x),"
    " LZ AS (SELECT LB.*, CD.band, row_number() OVER (PARTITION BY LB.channel, window_start, branch, CD.band ORDER BY dcf DESC, lag_bin_center) AS r FROM LB JOIN CD ON LB.channel = CD.channel JOIN (" + bands_sql() + ") BB ON BB.band = CD.band AND lag_bin_center BETWEEN lo AND hi WHERE pairs >= 30 AND dcf IS NOT NULL)"
)


@query(_LOCAL + " SELECT channel, band, branch, window_start, lag_bin_center, round(dcf, 7) AS dcf, pairs FROM LZ WHERE r = 1")
def localised_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bins in sliding windows, of the channels and bands that a run of the tests names."""
    store, run = _tested(spark, sf_dir)
    rows = _rows(spark, sf_dir)
    found = review.candidates(store.read(run).where(F.col("q_bh") < _LEVEL), ["channel", "band"])
    span = series.common_span(rows, ["channel", "side"]).first()
    wins = series.windows_frame(spark, series.calendar_windows(span["first"], span["last"], 3) if span else [])
    return tidy(phases.localised(rows, found, wins, BANDS, LO, HI, WIDTH))


_AN, _ALO, _AHI = 3000, 200, 700
_GRID = spectral_queries._freqs(_ALO, _AHI, _AN)
_ATLAS = "WITH RECURSIVE " + _SD + f", PT AS {_TESTS}" + (
    ", SPO AS (SELECT channel, side, min(date) AS lo, max(date) AS hi FROM SD WHERE value > 0 GROUP BY ALL), SPA AS (SELECT channel, side, 'own' AS span, lo, hi FROM SPO UNION ALL SELECT channel, side, 'common', max(lo) OVER c, min(hi) OVER c FROM SPO WINDOW c AS (PARTITION BY channel)),"
    " SPK AS (SELECT channel || '|' || side || '|' || span AS ck, lo, hi FROM SPA), AK AS (SELECT channel || '|' || side || '|' || span AS ck, date, value FROM SD JOIN SPA USING (channel, side) WHERE date BETWEEN lo AND hi AND value > 0)"
) + "".join(spectral_queries.prepared_sql("AK", "ck", d, True, f"A{v[0]}") + spectral_queries.lomb_sql(_GRID, "ck", True, src=f"A{v[0]}", name=f"L{v[0]}") + spectral_queries.morph_sql(f"L{v[0]}", f"M{v[0]}", "ck") for v, d in _DETREND.items()) + (
    spectral_queries.window_sql("AK", _ALO, _AHI, "ck", True, "(SELECT * FROM SPK)") + spectral_queries.morph_sql("SW", "MW", "ck")
    + ", TW AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY prominence DESC, power DESC, period_days) AS rank FROM MWPR WHERE peak) WHERE rank <= 12)"
    + ", SG AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, * FROM M{v[0]}" for v in _DETREND) + ")"
    + ", NW AS (SELECT SG.ck, variant, SG.band, SG.period_days AS p, SG.is_local_peak, SG.at_band_edge, TW.period_days AS w, abs(1 / TW.period_days - 1 / SG.period_days) * (date_diff('day', lo, hi) + 1) AS sep, row_number() OVER (PARTITION BY SG.ck, variant, SG.band ORDER BY abs(1 / TW.period_days - 1 / SG.period_days), TW.period_days) AS r FROM SG JOIN SPK ON SPK.ck = SG.ck LEFT JOIN TW ON TW.ck = SG.ck)"
    + ", NA1 AS (SELECT split_part(ck, '|', 1) AS channel, split_part(ck, '|', 2) AS side, split_part(ck, '|', 3) AS span, * FROM NW WHERE r = 1)"
    + ", OV0 AS (SELECT channel, side, date, log10(value) AS v, date_diff('day', DATE '1970-01-01', date) AS t FROM SD WHERE value > 0), OV1 AS (SELECT *, v - avg(v) OVER o AS y, t - avg(t) OVER o AS u FROM OV0 WINDOW o AS (PARTITION BY channel, side)), OV AS (SELECT channel || '|' || side || '|raw' AS ov, date, v FROM OV0 UNION ALL SELECT channel || '|' || side || '|detrended', date, y - sum(y * u) OVER o / sum(u * u) OVER o * u FROM OV1 WINDOW o AS (PARTITION BY channel, side)), OZ AS (SELECT ov, date, coalesce((v - avg(v) OVER o) / nullif(stddev_pop(v) OVER o, 0), 0) AS z FROM OV WINDOW o AS (PARTITION BY ov))"
    + dcf_sql("OZ", "OZ", _ALO, _AHI, "ov") + f", Q AS (SELECT * FROM DB WHERE pairs >= {LEAST} AND dcf IS NOT NULL)" + runs_sql("Q", "lag_bin_center", "dcf", "ov") + prominence_sql("lag_bin_center", "dcf", "ov")
    + f", LM AS (SELECT * FROM (SELECT split_part(ov, '|', 1) AS channel, split_part(ov, '|', 2) AS side, split_part(ov, '|', 3) AS variant, band, lag_bin_center AS lag, dcf, peak, lag_bin_center <= lo + {WIDTH / 2} OR lag_bin_center >= hi - {WIDTH / 2} AS edge, row_number() OVER (PARTITION BY ov, band ORDER BY dcf DESC, lag_bin_center) AS r FROM PR JOIN (" + bands_sql() + ") ON lag_bin_center BETWEEN lo AND hi) WHERE r = 1)"
)


def _pivot_sql(columns: dict[str, str], condition: str, rounded: Sequence[str] = ()) -> str:
    return ", ".join(f"max(CASE WHEN {condition.format(s=s)} THEN {f'round({c}, 7)' if n in rounded else c} END) AS {n}_{s}" for s in "ab" for n, c in columns.items())


_LS = {"ls_period": "p", "ls_local_peak": "is_local_peak", "ls_band_edge": "at_band_edge", "window_period": "w", "window_separation": "sep", "alias_warning": "sep <= 1"}
_ATLAS += (
    f", A1 AS (SELECT channel, band, variant, {_pivot_sql(_LS, 'side = {q}{{s}}{q} AND span = {q}own{q}'.format(q=chr(39)), ('ls_period', 'window_period', 'window_separation'))} FROM NA1 GROUP BY ALL),"
    f" A2 AS (SELECT channel, band, variant, {_pivot_sql(_LS, 'side = {q}{{s}}{q} AND span = {q}common{q}'.format(q=chr(39)))} FROM NA1 GROUP BY ALL),"
    f" A3 AS (SELECT channel, band, variant, {_pivot_sql({'acf_lag': 'lag', 'acf_dcf': 'dcf', 'acf_local_peak': 'peak', 'acf_band_edge': 'edge'}, 'side = {q}{{s}}{q}'.format(q=chr(39)), ('acf_dcf',))} FROM LM GROUP BY ALL),"
    f" A4 AS (SELECT channel, band, variant, {_pivot_sql({c: c for c in ('p', 'p_holm', 'q_bh')}, 'branch = {q}acf_{{s}}{q}'.format(q=chr(39)), ('p', 'p_holm', 'q_bh'))} FROM PT GROUP BY ALL)"
)
_OF_A2 = {
    "common_period_difference": "round(abs(A2.ls_period_a - A2.ls_period_b), 7)", "common_within_10_percent": "abs(A2.ls_period_a - A2.ls_period_b) / ((A2.ls_period_a + A2.ls_period_b) / 2) <= 0.1",
    "either_common_alias_warning": "coalesce(A2.alias_warning_a, false) OR coalesce(A2.alias_warning_b, false)", "either_common_band_edge": "coalesce(A2.ls_band_edge_a, false) OR coalesce(A2.ls_band_edge_b, false)",
    "both_common_local_peaks": "coalesce(A2.ls_local_peak_a AND A2.ls_local_peak_b, false)",
}


@query(_ATLAS + " SELECT A1.*, " + ", ".join(f"A3.{n}_{s}" for s in "ab" for n in ("acf_lag", "acf_dcf", "acf_local_peak", "acf_band_edge")) + ", " + ", ".join(f"A4.{n}_{s}" for s in "ab" for n in ("p", "p_holm", "q_bh")) + ", SPO.hi < DATE '1999-01-01' AS quality_limited, " + ", ".join(f"{e} AS {n}" for n, e in _OF_A2.items()) + " FROM A1 LEFT JOIN A2 USING (channel, band, variant) LEFT JOIN A3 USING (channel, band, variant) LEFT JOIN A4 USING (channel, band, variant) LEFT JOIN SPO ON SPO.channel = A1.channel AND SPO.side = 'b'")
def periodicity_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags, spectra and sampling windows of both sides beside the tests of an earlier run."""
    store, run = _tested(spark, sf_dir)
    return tidy(phases.atlas(_rows(spark, sf_dir), BANDS, store.read(run), _ALO, _AHI, WIDTH, _AN, LEAST, "1999-01-01"))


# the same with stand-in p-values, which SQL can make

_STRENGTH = {"acf_a": 1, "acf_b": 2, "ccf": 3}
_WIDE = _wide_sql({"raw": "1", "detrended": "3"}, ("lag_days", "dcf", "p", "p_holm", "q_bh"))
_BRANCHED = inference_queries._P + ", BR AS (SELECT channel, band, variant, branch, lag_bin_center AS lag_days, dcf, CASE WHEN channel = '5-LOW' AND band = 'long' THEN NULL ELSE round(exp(-variant * (s + CASE WHEN branch = 'ccf' THEN 1 ELSE 0 END) * abs(dcf) * sqrt(pairs) / 4), 6) END AS p FROM Z, (SELECT unnest([1, 3]) AS variant), (VALUES " + ", ".join(f"('{b}', {s})" for b, s in _STRENGTH.items()) + ") v(branch, s) WHERE r = 1), BK AS (SELECT *, row_number() OVER (PARTITION BY band, variant, branch ORDER BY p, channel) AS i, count(p) OVER (PARTITION BY band, variant, branch) AS m FROM BR WHERE p IS NOT NULL), BJ AS (SELECT channel, band, variant, branch, max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY band, variant, branch ORDER BY i) AS p_holm, min(least(1.0, m * p / i)) OVER (PARTITION BY band, variant, branch ORDER BY i DESC) AS q_bh FROM BK), BD AS (SELECT BR.*, p_holm, q_bh FROM BR LEFT JOIN BJ USING (channel, band, variant, branch)), BW AS (SELECT channel, band, " + _WIDE + " FROM BD GROUP BY 1, 2)"


@query(_BRANCHED + f" SELECT *, {_flags_sql(499, 5, 'false')} FROM BW")
def branch_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = inference_queries._adjusted(spark, sf_dir, others=["pairs"]).select("channel", "band", "variant", "pairs", F.col("dcf").alias("observed"), F.col("lag_days").alias("observed_at"))
    rows = best.select("*", F.explode(F.create_map(*(F.lit(x) for b in _STRENGTH.items() for x in b))).alias("branch", "s"))
    known = ~((F.col("channel") == "5-LOW") & (F.col("band") == "long"))
    p = [F.when(known, F.round(F.exp(-F.col("variant") * (F.col("s") + more) * F.abs("observed") * F.sqrt("pairs") / 4), 6)) for more in (0, 1)]
    tests = rows.withColumns({"p_ar1": p[0], "p_shift": p[1]}).withColumn("p", review.branch_p()).withColumn("variant", F.when(F.col("variant") == 1, "raw").otherwise("detrended"))
    return tidy(review.by_branch(review.adjusted_by_branch(tests), ["channel", "band"], 499, members=5))


_CAND = inference_queries._ADJ + windows_sql() + ", CD AS (SELECT DISTINCT channel, band FROM AD WHERE q_bh < 0.05), WA AS (SELECT channel || '|' || window_start AS cw, date, value FROM O JOIN W ON date BETWEEN window_start AND window_stop WHERE channel IN (SELECT channel FROM CD))" + z_sql("ZA", "WA", "cw") + inference_queries._suffixed(dcf_sql("ZA", "ZA", LO, HI, "cw"), "_w") + ", CB AS (SELECT split_part(cw, '|', 1) AS channel, CAST(split_part(cw, '|', 2) AS DATE) AS window_start, lag_bin_center, dcf, pairs FROM DB_w), CZ AS (SELECT CB.*, CD.band, row_number() OVER (PARTITION BY CB.channel, window_start, CD.band ORDER BY dcf DESC, lag_bin_center) AS r FROM CB JOIN CD ON CB.channel = CD.channel JOIN BB ON BB.band = CD.band AND lag_bin_center BETWEEN lo AND hi WHERE pairs >= 30 AND dcf IS NOT NULL)"


@query(_CAND + " SELECT channel, band, window_start, lag_bin_center, round(dcf, 7) AS dcf, pairs FROM CZ WHERE r = 1")
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bins in sliding windows, of the channels and bands that the review names only."""
    found = review.candidates(inference_queries._adjusted(spark, sf_dir).where("q_bh < 0.05"), ["channel", "band"])
    rows = series.in_windows(inputs.orders(spark, sf_dir).join(found, "channel", "left_semi"), windows(spark, sf_dir)).select("channel", "window_start", "date", "value")
    keys = ["channel", "window_start"]
    dcf = lagcorr.binned(lagcorr.discrete_correlation(rows, rows, keys, LO, HI), keys, WIDTH, LO)
    best = peaks.band_maximum(dcf, keys, "lag_bin_center", "dcf", BANDS, 30, others=["pairs"])
    return tidy(best.join(found, ["channel", "band"], "left_semi"))


@query(spectral_queries._SPEC + spectral_queries.morph_sql("LS", "MS") + ", PR0 AS (SELECT * FROM (" + inference_queries._ADJ + " SELECT * FROM AD)) SELECT MS.channel, MS.band, CAST(v.variant AS BIGINT) AS variant, round(MS.period_days, 7) AS period_days, MS.is_local_peak, round(p, 7) AS p, round(q_bh, 7) AS q_bh, coalesce(q_bh < 0.05, false) AND MS.is_local_peak AS supported FROM MS CROSS JOIN (SELECT unnest([1, 3]) AS variant) v LEFT JOIN PR0 ON PR0.channel = MS.channel AND PR0.band = MS.band AND PR0.variant = v.variant")
def evidence_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral band peaks beside the tests of an earlier phase, looked up in its documents by channel, band and variant."""
    path = f"{shared_folder(spark)}/phase-{uuid.uuid4().hex}"
    tests = inference_queries._adjusted(spark, sf_dir).select("channel", "band", "variant", "p", "q_bh")
    sinks.as_documents(tests, []).select("document").write.text(path)
    prior = text.read_documents(spark, path, tests.schema)
    now = peaks.spectrum_morphology(spectral_queries._spectrum(spark, sf_dir), ["channel"], BANDS).select("channel", "band", F.explode(F.array(F.lit(1), F.lit(3))).alias("variant"), "period_days", "is_local_peak")
    supported = F.coalesce(F.col("q_bh") < 0.05, F.lit(False)) & F.col("is_local_peak")
    return tidy(now.join(prior, ["channel", "band", "variant"], "left").withColumn("supported", supported))


_LENGTHS = (2, 3, 5)


@query(" UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS years, * FROM ({spectral_queries.win_sql(n)}{spectral_queries._USABLE} SELECT TT.side, TT.band, any_value(total) AS windows_total, count(sep) AS local_peak_windows, count(CASE WHEN sep <= 1 THEN 1 END) AS alias_windows, round(count(CASE WHEN sep <= 1 THEN 1 END) / nullif(count(sep), 0)::DOUBLE, 7) AS alias_fraction, round(median(sep), 7) AS median_rayleigh, round(median(abs(signal - window_period)), 7) AS median_period_difference_days, round(median(signal * signal / span), 7) AS median_period_resolution_days FROM TT LEFT JOIN US ON TT.side = US.side AND TT.band = US.band GROUP BY ALL)" for n in _LENGTHS))
def scale_summary_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of windows of every length, in one job over all lengths."""
    return tidy(spectral_queries.summary_by_scale(spectral_queries.tracking(spark, sf_dir, (5, 3, 2, 3)), ["years", "side", "band"]))
