"""Signal recovery and small cases of the series operators."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidal.functions import dates, scalars
from tidal.operators import lagcorr, multiplicity, noise, nulls, peaks, quality, series, shifts, spectra, waves

DAY0 = date(1980, 1, 1)


def frame(spark, values, keep=None, start=DAY0):
    rows = [(start + timedelta(days=i), float(v)) for i, v in enumerate(values) if keep is None or keep[i]]
    return spark.createDataFrame(rows, "date date, value double")


def one(df):
    return df.first().asDict()


def test_gapped_sine_period(spark):
    rng = np.random.default_rng(1)
    t = np.arange(3000)
    rows = frame(spark, np.sin(2 * np.pi * t / 470), rng.random(3000) > 0.2)
    best = spectra.lomb_scargle_series(rows, [], 20, 2000, 800).orderBy(F.desc("power")).first()
    assert abs(best["period_days"] - 470) < 20


def test_log_sine_period(spark):
    rng = np.random.default_rng(2)
    t = np.arange(3000)
    rows = frame(spark, 10 ** (1 + 0.2 * np.sin(2 * np.pi * t / 480)), rng.random(3000) > 0.25)
    best = spectra.lomb_scargle_log(rows, [], 100, 900, 600).orderBy(F.desc("power")).first()
    assert abs(best["period_days"] - 480) < 15


def test_ar1_estimates(spark):
    model = noise.Recurrence(17, 3, 0.7, 0, block=4000)
    x = model.from_zero(np.arange(1), 0)[0]
    rows = frame(spark, x).withColumn("k", F.lit(1))
    assert abs(one(nulls.ar1_by_row(rows, ["k"]))["phi"] - 0.7) < 0.05
    assert abs(one(nulls.ar1_by_day(rows, ["k"]))["phi"] - 0.7) < 0.05


def test_adjacent_pairs_only(spark):
    keep = [True, True, False, False, True, True, True]
    rows = frame(spark, [1, 2, 0, 0, 3, 5, 4], keep).withColumn("k", F.lit(1))
    assert one(nulls.ar1_by_day(rows, ["k"]))["pairs"] == 3


def test_cross_lag_sign(spark):
    a, b = frame(spark, [1, 2, 3], start=date(2000, 1, 11)), frame(spark, [1, 2, 3], start=date(2000, 1, 1))
    got = one(lagcorr.calendar_correlation(a, b, [], 10, 10))
    assert got["pairs"] == 3 and got["pearson_raw"] == pytest.approx(1)


def test_constant_series_has_no_correlation(spark):
    a = frame(spark, [2.0] * 20)
    got = one(lagcorr.calendar_autocorrelation(a, [], 1, 1))
    assert got["pearson_raw"] is None and got["cosine_raw"] == pytest.approx(1)


def test_dcf_at_zero_is_one(spark):
    rows = frame(spark, np.exp(np.arange(100) / 30))
    assert one(lagcorr.discrete_correlation(rows, rows, [], 0, 0))["dcf"] == pytest.approx(1, abs=1e-12)


def test_empty_lags_stay(spark):
    rows = frame(spark, [1, 2, 4])
    got = {r["lag_calendar_days"]: r for r in lagcorr.discrete_correlation(rows, rows, [], 1, 5).collect()}
    assert got[5]["pairs"] == 0 and got[5]["dcf"] is None


def test_fast_dcf_equals_exact(spark):
    rng = np.random.default_rng(4)
    keep = rng.random(400) > 0.18
    keep[[0, -1]] = True
    values = np.exp(np.sin(2 * np.pi * np.arange(400) / 57) + 0.1 * rng.standard_normal(400))
    rows = frame(spark, values, keep)
    exact = {r["lag_calendar_days"]: r for r in lagcorr.discrete_correlation(rows, rows, [], 1, 150).collect()}
    z = np.log10(values)
    z, m = np.where(keep, (z - z[keep].mean()) / z[keep].std(), 0.0), keep.astype(int)
    assert [exact[k]["pairs"] for k in range(1, 151)] == [m[k:] @ m[:-k] for k in range(1, 151)]
    assert np.allclose([exact[k]["dcf"] for k in range(1, 151)], [(z[k:] @ z[:-k]) / (m[k:] @ m[:-k]) for k in range(1, 151)], atol=1e-10)


def test_delayed_copy_lag(spark):
    rng = np.random.default_rng(5)
    base = np.exp(np.sin(2 * np.pi * np.arange(1700) / 173) + 0.2 * rng.standard_normal(1700))
    a, b = frame(spark, base[:-40], rng.random(1660) > 0.15), frame(spark, base[40:], rng.random(1660) > 0.18)
    best = one(peaks.band_maximum(lagcorr.binned(lagcorr.discrete_correlation(a, b, [], 0, 90), [], 5, 0), [], "lag_bin_center", "dcf", {"all": (0, 90)}, 100))
    assert abs(best["lag_bin_center"] - 40) <= 5 and best["dcf"] > 0.8


def test_impulse_lag(spark):
    x, y = np.zeros(200), np.zeros(200)
    x[50] = y[70] = 1
    at = lambda v: spark.createDataFrame([(i, float(z)) for i, z in enumerate(v)], "i long, value double")
    best = lagcorr.sample_correlation(at(x), at(y), [], -100, 100).orderBy(F.desc("coefficient")).first()
    assert abs(best["lag_days"]) == 20 and best["coefficient"] == pytest.approx(1)


def test_fft_and_power_of_two(spark):
    assert [r[0] for r in spark.createDataFrame([(7042,), (1,), (8192,), (3,)], "n long").select(scalars.next_power_of_two(F.col("n"))).collect()] == [8192, 1, 8192, 4]
    rows = frame(spark, np.sin(2 * np.pi * np.arange(7042) / 470)).withColumn("k", F.lit(1))
    best = spectra.fourier_full(rows, ["k"]).orderBy(F.desc("power")).first()
    assert abs(best["period_days"] - 470) < 30
    band = {round(r["period_days"], 6): r["power"] for r in spectra.fourier_band(rows, ["k"], 300, 700).collect()}
    assert band[round(best["period_days"], 6)] == pytest.approx(best["power"])


def test_decimal_years(spark):
    row = spark.range(1).select(dates.from_decimal_year(F.lit(72.1721)).alias("d"), dates.to_decimal_year(F.lit("1980-02-29").cast("date")).alias("v")).first()
    assert row["d"] == date(1972, 1, 1) + timedelta(days=62) and row["v"] == pytest.approx(80 + 60 / 365)


def test_quality_mask_boundary(spark):
    rows = spark.createDataFrame([("x", date(1980, 8, 25), 1.0), ("x", date(1980, 8, 26), 1.0), ("y", date(1980, 8, 26), 1.0)], "c string, date date, value double")
    got = {(r["c"], r["date"].day): r["value"] for r in series.quality_mask(rows, F.col("c") == "x", "1980-08-26").collect()}
    assert got == {("x", 25): 1.0, ("x", 26): None, ("y", 26): 1.0}


def test_delay_and_index_shift(spark):
    assert spark.range(1).select(scalars.delay_days(F.lit(2.0), F.lit(1.0), F.lit(400.0))).first()[0] == 4
    rows = spark.createDataFrame([(DAY0 + timedelta(days=i), 1.0, float(i), 4) for i in range(20)] + [(DAY0 + timedelta(days=20), 0.0, 20.0, 4), (DAY0 + timedelta(days=21), 1.0, 21.0, None)], "date date, a double, b double, delay_days int")
    got = {r["date"]: r for r in lagcorr.index_shifted(rows).collect()}
    assert got[DAY0 + timedelta(days=10)]["shifted"] == 6 and got[DAY0 + timedelta(days=3)]["source"] == -1
    assert got[DAY0 + timedelta(days=20)]["shifted"] == 0 and got[DAY0 + timedelta(days=21)]["source"] == -1


def test_mean_speed(spark):
    cases = [(400.0, 500.0, 450.0), (None, 500.0, 500.0), (0.0, 500.0, 500.0), (300.0, None, 300.0), (None, 0.0, 400.0)]
    rows = spark.createDataFrame(cases, "a double, b double, want double")
    assert all(r[0] == r[1] for r in rows.select(scalars.mean_speed(F.col("a"), F.col("b")), "want").collect())


def test_calendar_windows():
    got = series.calendar_windows(date(2000, 3, 1), date(2010, 3, 1), 4, 2)
    assert len(got) == 4 and got[0][1] == date(2004, 2, 29)
    assert series.calendar_windows(date(1996, 2, 29), date(2001, 3, 1), 1)[-1][0].day == 28


def test_duplicate_policies(spark):
    rows = spark.createDataFrame([(DAY0, 1.0, 0), (DAY0, 3.0, 1)], "date date, value double, at int")
    assert one(series.one_per_date(rows, [], "mean"))["value"] == 2
    assert one(series.one_per_date(rows, [], "first", ["at"]))["value"] == 1
    with pytest.raises(Exception, match="duplicate"):
        series.one_per_date(rows, []).collect()


def test_detrend_removes_line(spark):
    rows = frame(spark, 3 + 0.5 * np.arange(100) + np.sin(np.arange(100))).withColumn("k", F.lit(1))
    flat = series.detrended(series.with_day(rows), ["k"], "linear")
    assert abs(flat.select(F.regr_slope("value", "day")).first()[0]) < 1e-9


def test_peak_rules(spark):
    y = [0.0, 2.0, 1.0, 3.0, 3.0, 0.5, 1.5, 1.5, 1.5, 4.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "x int, y double")
    got = {r["x"]: r for r in peaks.prominences(rows, [], "x", "y").collect()}
    assert [x for x in got if got[x]["is_local_peak"]] == [1, 3]
    assert got[1]["prominence"] == 1.0 and got[3]["prominence"] == 2.5


def test_holm_and_bh(spark):
    rows = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", None)], "f string, c string, p double")
    got = {r["c"]: r for r in multiplicity.adjusted(rows, ["f"]).collect()}
    assert [round(got[c]["p_holm"], 6) for c in "abc"] == [0.03, 0.06, 0.06]
    assert [round(got[c]["q_bh"], 6) for c in "abc"] == [0.03, 0.04, 0.04] and got["d"]["p_holm"] is None


def test_null_counts(spark):
    null = spark.createDataFrame([("b", float(i)) for i in range(99)] + [("b", None)], "band string, statistic double")
    got = one(multiplicity.null_summary(null, spark.createDataFrame([("b", 98.0)], "band string, statistic double"), ["band"]))
    assert got["p_value"] == pytest.approx(2 / 100) and got["used"] == 99 and got["null_q95"] == pytest.approx(93.1)


def test_recurrence_is_independent_of_blocks(spark):
    days = [i for i in range(-700, 1500) if i % 7]
    rows = spark.createDataFrame([("x", i) for i in days], "k string, day long")
    phi = spark.createDataFrame([("x", 0.93)], "k string, phi double")
    for stationary in (True, False):
        got = noise.long_rows(noise.surrogates(rows.repartition(5), phi, ["k"], 60, 5, stationary), rows).toPandas()
        name = spark.createDataFrame([("x",)], "k string").select(noise.stream(["k"])).first()[0]
        e = noise.normal(name, 5, np.arange(60), np.arange(days[0], 1500))
        want = np.empty_like(e)
        want[:, 0] = e[:, 0] if stationary else 0
        for t in range(1, e.shape[1]):
            want[:, t] = 0.93 * want[:, t - 1] + math.sqrt(1 - 0.93**2) * e[:, t]
        assert len(got) == 60 * len(days) and np.allclose(got["value"], want[got["sim"], got["day"] - days[0]], atol=1e-12)


@pytest.mark.parametrize("phi, n, block", [(0.9, 200, 64), (-0.4, 64, 37), (0.0, 65, 65), (0.3, 1, 5)])
def test_block_equals_the_recursion(phi, n, block):
    model, sims = noise.Recurrence(9, 5, phi, 0, True, block), np.arange(3)
    ends = np.stack([model.from_zero(sims, b)[:, -1] for b in range((n - 1) // block + 1)], axis=1)
    got = model.values(sims, np.arange(n), model.starts(ends), 0)
    e = noise.normal(9, 5, sims, np.arange(n))
    want = [e[:, 0]]
    for t in range(1, n):
        want.append(phi * want[-1] + math.sqrt(1 - phi * phi) * e[:, t])
    assert np.allclose(got, np.stack(want, axis=1))


def test_noise_is_white_and_normal():
    e = noise.normal(1, 2, np.arange(200), np.arange(1000))
    assert abs(e.mean()) < 0.01 and abs(e.std() - 1) < 0.01 and abs((e**4).mean() - 3) < 0.1
    assert np.abs(np.corrcoef(e) - np.eye(200)).max() < 0.17 and abs(np.corrcoef(e[:, 1:].ravel(), e[:, :-1].ravel())[0, 1]) < 0.01
    assert len(np.unique(noise.mixed(np.arange(1 << 16)))) == 1 << 16


@pytest.mark.parametrize("lo, block", [(50, 512), (50, 100), (-95, 512), (-25, 100)])
def test_rotations_against_brute_force(spark, lo, block):
    r, n, margin = np.random.default_rng(1), 500, 120
    a, b = (np.where(r.random(n) < 0.3, np.nan, r.standard_normal(n)) for _ in range(2))
    rows = lambda v: spark.createDataFrame([("k", n, i, float(x)) for i, x in enumerate(v) if np.isfinite(x)], "k string, n int, i int, value double")
    got = {(x["shift"], x["lag_bin_center"]): (x["pairs"], x["dcf"]) for x in shifts.rotated_bins(rows(a), rows(b), ["k"], lo, lo + 45, 10, margin, block).collect()}
    met = lambda u, v, k: u[k:] @ v[: n - k] if k >= 0 else u[: n + k] @ v[-k:]
    assert len(got) == 5 * (n - 2 * margin + 1)
    for s in range(margin, n - margin + 1):
        y = np.roll(b, s)
        sums = np.array([[met(np.isfinite(a) * 1, np.isfinite(y) * 1, k), met(np.nan_to_num(a), np.nan_to_num(y), k)] for k in range(lo, lo + 46)])
        for q in range(5):
            pairs, total = sums[10 * q : 10 * q + 10].sum(axis=0)
            assert got[s, lo + 10 * q + 4.5] == (pairs, pytest.approx(total / pairs, abs=1e-10))


def test_extirpolated_sums_equal_direct_ones():
    r = np.random.default_rng(2)
    t, w = np.sort(r.random(900)) * 3000 + 9000, np.vstack([np.ones(900), r.standard_normal((2, 900))])
    grid = waves.frequency_grid(20, 4000, 5000)
    got, want = waves.wave_sums(t, w, grid, 2), w @ np.exp(-4j * np.pi * np.outer(t, grid.values()))
    assert np.abs(got - want).max() < 1e-10


@pytest.mark.parametrize("linear", [True, False])
def test_windows_of_every_length_from_panes(spark, linear):
    r, days = np.random.default_rng(3), 20 * 365 + 5
    t = np.flatnonzero(r.random(days) > 0.3)
    y = np.exp(np.sin(2 * np.pi * t / 470) + t / 4000 + 0.3 * r.standard_normal(len(t)))
    start = date(1980, 2, 29)
    rows = spark.createDataFrame([("c", start + timedelta(days=int(i)), float(v)) for i, v in zip(t, y)], "k string, date date, value double")
    wins = [(n, w) for n in (5, 8, 10, 12, 15) for w in series.calendar_windows(start, start + timedelta(days=days - 1), n, 2)]
    by = waves.Windows([w for _, w in wins], {"years": [n for n, _ in wins]})
    got = spectra.lomb_scargle_log(rows, ["k"], 200, 700, 1200, "linear" if linear else "none", by).toPandas()
    assert set(got["years"]) == {5, 8, 10, 12, 15} and len(got) == 1200 * len(wins)
    f = waves.frequency_grid(200, 700, 1200).values()
    for n, (a, b) in wins[::3]:
        inside = (t >= (a - start).days) & (t <= (b - start).days)
        x, v = t[inside].astype(float), np.log10(y[inside])
        v = v - (np.polyval(np.polyfit(x, v, 1), x) if linear else v.mean())
        c, s = np.cos(2 * np.pi * np.outer(f, x)), np.sin(2 * np.pi * np.outer(f, x))
        c, s = c - c.mean(1, keepdims=True), s - s.mean(1, keepdims=True)
        yc, ys, cc, ss, cs = c @ v, s @ v, (c * c).sum(1), (s * s).sum(1), (c * s).sum(1)
        want = (ss * yc**2 + cc * ys**2 - 2 * cs * yc * ys) / ((v @ v) * (cc * ss - cs**2))
        mine = got[(got["years"] == n) & (got["window_start"] == a)].sort_values("period_days", ascending=False)["power"].to_numpy()
        assert np.allclose(mine, want, atol=1e-9)
    window = waves.sampling_in_windows(rows, ["k"], 200, 700, by).toPandas()
    one = spectra.sampling_window(rows, ["k"], 200, 700, limits=spark.createDataFrame([("c", *wins[0][1])], "k string, first date, last date")).toPandas().sort_values("period_days")
    mine = window[(window["years"] == 5) & (window["window_start"] == wins[0][1][0])].sort_values("period_days")
    assert np.allclose(mine[["period_days", "power"]], one[["period_days", "power"]], atol=1e-10)


def test_rows_before_the_first_shuffle_do_not_grow_with_overlap(spark):
    rows = frame(spark, np.exp(np.sin(np.arange(4000) / 70))).withColumn("k", F.lit(1))
    span = (rows.agg(F.min("date"), F.max("date"))).first()
    count = {n: waves.by_pane(rows, waves.Windows(series.calendar_windows(span[0], span[1], n))).count() for n in (2, 5, 9)}
    assert max(count.values()) <= 4000


def test_year_windows_follow_each_key(spark):
    rows = spark.createDataFrame([("x", date(2000, 2, 29) + timedelta(days=i)) for i in range(0, 2000, 3)], "k string, date date").withColumns({"_first": F.lit("2000-02-29").cast("date"), "_last": F.lit("2005-02-27").cast("date")})
    got = waves.YearWindows(3, 2).placed(rows).groupBy("_pane").agg(F.min("date"), F.max("date"), F.max("_panes")).orderBy("_pane").collect()
    assert [r[3] for r in got] == [5] * 5 and got[1][1] >= date(2001, 2, 28) and got[-1][2] <= date(2005, 2, 27)
    import pandas as pd

    assert waves.YearWindows(3, 2).spans(pd.DataFrame({"_panes": [5]})) == [(0, 3), (2, 5)]


def sided(spark, a, b):
    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(max(len(a), len(b)))]
    rows = [(1, s, d, float(v)) for s, x in (("a", a), ("b", b)) for d, v in zip(days, x) if np.isfinite(v)]
    return spark.createDataFrame(rows, "k int, side string, date date, value double")


def test_cycle_beats_red_noise(spark):
    r, t = np.random.default_rng(8), np.arange(1600)
    x = np.where(r.random(1600) < 0.12, np.nan, np.sin(2 * np.pi * t / 80) + 0.2 * r.standard_normal(1600))
    rows = sided(spark, x, []).drop("side")
    got = {x["band"]: x for x in nulls.ar1_dcf_null(rows, ["k"], {"near": (70, 90)}, 99, 40, 120, 5).collect()}["near"]
    assert got["status"] == "ok" and got["p_value"] <= 0.05 and got["used"] == 99 and got["observed"] > 0.5 and got["null_q95"] <= got["null_q99"]
    assert one(nulls.ar1_spectral_null(rows, ["k"], (60, 100), 99))["p_value"] <= 0.05
    assert one(nulls.red_noise_null(rows, ["k"], (60, 100), 99, 100))["p_value"] <= 0.05
    few = nulls.ar1_spectral_null(rows.limit(20), ["k"], (60, 100), 19).collect()[0]
    assert few["status"] == "insufficient_data" and few["p_value"] is None and few["used"] == 0


def test_shift_null(spark):
    r = np.random.default_rng(9)
    x = np.convolve(r.standard_normal(1900), np.ones(20) / 20, "same")
    a, b = x[60:1860], x[:1800]  # b tells what a told 60 days before
    rows = sided(spark, np.where(r.random(1800) < 0.1, np.nan, a), np.where(r.random(1800) < 0.1, np.nan, b))
    got = [nulls.circular_shift_null(rows, ["k"], {"near": (low, low + 30)}, 99, low - 10, low + 40, 5, 100, 200).collect()[0] for low in (-75, 45)]
    assert min(g["p_value"] for g in got) <= 0.05 < max(g["p_value"] for g in got)
    assert one(nulls.circular_shift_null(rows, ["k"], {"near": (45, 75)}, 9, 30, 90, 5))["status"] == "ok"
    assert one(nulls.circular_shift_null(rows, ["k"], {"near": (45, 75)}, 9, 30, 90, 5, margin=950))["status"] == "span_too_short_for_shift_null"
    assert one(nulls.circular_shift_null(rows.where("side = 'a'"), ["k"], {"near": (45, 75)}, 9))["status"] == "insufficient_data"


def test_joint_null(spark):
    r, t = np.random.default_rng(10), np.arange(5844)
    on = (t > 2000) & (t < 3500)
    a, b = (np.where(t % n == 0, np.nan, on * np.sin(2 * np.pi * t / 180) + 0.3 * r.standard_normal(len(t))) for n in (17, 19))
    got = {x["band"]: x for x in nulls.joint_null(sided(spark, a, b), ["k"], (150, 220), 39, periods=40, years=4, step=2).collect()}
    assert set(got) == {"a", "b", "joint"} and all(x["status"] == "ok" and x["p_value"] <= 0.05 for x in got.values())
    assert got["joint"]["observed"] <= max(got["a"]["observed"], got["b"]["observed"])
    short = nulls.joint_null(sided(spark, a[:900], b[:900]), ["k"], (150, 220), 5, years=4).collect()
    assert [x["status"] for x in short] == ["insufficient_window_data"] * 3 and all(x["p_value"] is None for x in short)


def test_spacing_report(spark):
    rows = frame(spark, range(7), [1, 1, 0, 1, 0, 0, 1]).withColumn("k", F.lit(1))
    got = one(quality.spacing(rows, ["k"]))
    assert (got["common_rows"], got["one_day_steps"], got["gaps_gt_1_day"], got["max_gap_days"]) == (4, 1, 2, 3)


def test_field_summary(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,), (None,), (math.inf,), (math.nan,)], "v double")
    assert one(quality.field_summary(rows, ["v"])) == {"field": "v", "rows": 5, "finite": 2, "missing": 2, "zeros": 1}


def test_sampling_window_stays_in_range(spark):
    keep = [i % 7 != 0 for i in range(1000)]
    got = spectra.sampling_window(frame(spark, np.ones(1000), keep).withColumn("k", F.lit(1)), ["k"], 20, 500).collect()
    assert got and all(20 <= r["period_days"] <= 500 for r in got)


def test_review_by_branch(spark):
    from tidal.operators import review

    rows = [("c", "x", v, b, 0.5, 470.0, p, s) for v in review.VARIANTS for b, p, s in (("acf_a", 0.9, 0.8), ("acf_b", 0.7, 0.6), ("ccf", 0.01, 0.1))]
    rows += [("d", "x", "raw", "ccf", None, None, None, None)]
    tests = spark.createDataFrame(rows, "channel string, band string, variant string, branch string, observed double, observed_at double, p_ar1 double, p_shift double").withColumn("p", review.branch_p())
    got = {r["channel"]: r for r in review.by_branch(review.adjusted_by_branch(tests), ["channel", "band"], 9, members=12, affected=("d",)).collect()}
    # the shift test counts for ccf, red noise for the rest; a missing test flags nothing and doesn't count in its family
    assert (got["c"]["raw_acf_a_p"], got["c"]["raw_ccf_p"], got["c"]["detrended_acf_b_p"]) == (0.9, 0.1, 0.7)
    assert got["c"]["raw_ccf_holm"] == got["c"]["raw_ccf_fdr"] == 0.1 and got["c"]["raw_at_floor"] and not got["c"]["robust"]
    assert got["d"]["raw_ccf_p"] is None and got["d"]["detrended_ccf_p"] is None and not got["d"]["raw_significant"] and not got["d"]["raw_at_floor"]
    assert got["c"]["raw_ccf_lag"] == 470 and got["d"]["raw_ccf_lag"] is None and (got["c"]["quality_limited"], got["d"]["quality_limited"]) == (False, True)
    assert got["c"]["p_floor"] == 0.1 and got["c"]["holm_floor"] == 1.0
    assert review.by_branch(review.adjusted_by_branch(tests.where("channel = 'e'")), ["channel", "band"], 9, 12).count() == 0


def test_documents_over_several_lines(spark, tmp_path):
    from tidal.sources import text

    (tmp_path / "a.json").write_text('[\n  {"channel": "c",\n   "p": 0.5},\n  {"channel": "d"}\n]')
    got = text.read_documents(spark, str(tmp_path), "channel string, p double", lines=False)
    assert sorted(tuple(r) for r in got.collect()) == [("c", 0.5), ("d", None)]


def test_window_lengths_once(spark):
    from tidal.plans import spectral_queries

    got = spectral_queries.tracking(spark, "/root/testdata/sf0.001", (3, 1, 3, 5)).select("years").distinct()
    assert sorted(r[0] for r in got.collect()) == [3, 5]


def test_locked_tests_carry_statuses(spark):
    from tidal.operators import phases

    r, t = np.random.default_rng(11), np.arange(1500)
    x = np.exp(np.sin(2 * np.pi * t / 90) + 0.3 * r.standard_normal(1500))
    rows = sided(spark, x, x[::-1]).drop("k").withColumn("channel", F.lit("c"))
    few = sided(spark, x[:20], x[:20]).drop("k").withColumn("channel", F.lit("few"))
    locked = spark.createDataFrame([("c", "near", "primary"), ("few", "near", "other"), ("none", "near", "other")], "channel string, band string, role string")
    got = phases.locked_spectral(rows.unionByName(few), locked, (70, 110), 39, 40).collect()
    assert len(got) == 3 * 2 * 2 and {(g["channel"], g["status"]) for g in got} == {("c", "ok"), ("few", "insufficient_data"), ("none", "insufficient_data")}
    for g in got:
        if g["channel"] == "c":  # two tests of a family count
            assert g["p_value"] == 0.025 and g["p_holm"] == 0.05 and g["q_bh"] == 0.025 and abs(g["observed_at"] - 90) < 3 and g["band"] == "near" and g["role"] == "primary"
        else:
            assert g["p_value"] is None and g["p_holm"] is None and g["q_bh"] is None
    both = {(g["channel"], g["variant"], g["statistic"]): g for g in phases.locked_joint(rows.unionByName(few), locked, (70, 110), 39, 40, 2, 1, 100).collect()}
    assert len(both) == 3 * 2 * 3 and both["few", "raw", "joint"]["status"] == "insufficient_window_data" and both["none", "raw", "a"]["status"] == "insufficient_data"
    joint = both["c", "raw", "joint"]
    assert joint["p_value"] == joint["p_holm"] == 0.025 and both["c", "raw", "a"]["p_holm"] is None
    assert joint["window_start"].year in (2000, 2001, 2002) and (joint["window_stop"] - joint["window_start"]).days in (729, 730)
