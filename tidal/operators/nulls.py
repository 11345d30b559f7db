"""Red-noise estimates and Monte-Carlo nulls.

Surrogates come from a recurrence over day blocks whose noise is addressed by number (see
``noise``), so that a test gives the same result however it is batched and partitioned,
and SQL can draw the same noise.  They are made where their statistic's partial sums are
taken, lag sums per day block or wave moments per pane, and only those leave a task.
Rotations are taken all at once (see ``shifts``).  Each test gives a status, the observed
statistic and where it lies, its p-value and quantiles of the null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import waves
from .blocks import kinds
from .lagcorr import binned, dcf_of_standardised, discrete_correlation
from .multiplicity import null_summary
from .noise import BLOCK, Surrogates, bits, stream, surrogates, uniform
from .peaks import band_maximum
from .series import detrended, indexed, standardised, with_day
from .shifts import rotated_bins
from .spectra import DETREND


def ar1_by_row(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, phi): sum y[i] y[i+1] / sum y[i]^2 of mean-free values in date order, within +-0.98; 0 without spread."""
    w = Window.partitionBy(*keys)
    y = rows.where("value IS NOT NULL").withColumn("y", F.col("value") - F.avg("value").over(w)).withColumn("z", F.lead("y").over(w.orderBy("date")))
    return _phi(y, keys, F.sum(F.when(F.col("z").isNotNull(), F.col("y") * F.col("y"))), 0.98, 2)


def ar1_by_day(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, phi, pairs) over neighbours one calendar day apart, within +-0.995; 0 for under 3 values or pairs."""
    w = Window.partitionBy(*keys)
    order = w.orderBy("date")
    y = rows.where("value IS NOT NULL").withColumn("y", F.col("value") - F.avg("value").over(w))
    y = y.withColumn("z", F.when(F.datediff(F.lead("date").over(order), "date") == 1, F.lead("y").over(order)))
    return _phi(y, keys, F.sum(F.when(F.col("z").isNotNull(), F.col("y") * F.col("y"))), 0.995, 3, with_pairs=True)


def _phi(y: DataFrame, keys: Sequence[str], norm: Column, limit: float, least: int, with_pairs: bool = False) -> DataFrame:
    got = y.groupBy(*keys).agg(F.sum(F.col("y") * F.col("z")).alias("a"), norm.alias("b"), F.count("z").alias("pairs"), F.count("y").alias("n"))
    phi = F.when((F.col("n") >= 3) & (F.col("pairs") >= least), F.greatest(F.lit(-limit), F.least(F.lit(limit), F.try_divide(F.col("a"), F.col("b")))))
    return got.select(*keys, F.coalesce(phi, F.lit(0.0)).alias("phi"), *(["pairs"] if with_pairs else []))


def tested(null: DataFrame, observed: DataFrame, status: DataFrame, keys: Sequence[str], bands: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Per key and band: status, observed and where it lies (at, and the columns also), p_value, exceedances, used and null quantiles, of null (keys, band, statistic) and observed (keys, band, statistic, at).

    status (keys, status) says why a key can't be tested; every key of it gets a row a band.
    """
    by = [*keys, "band"]
    frame = status.select(*keys, "status", F.explode(F.array(*map(F.lit, bands))).alias("band"))
    found = null_summary(null, observed.withColumnRenamed("at", "observed_at"), by, also=["observed_at", *also])
    ok = F.when(F.col("status") != "ok", F.col("status")).when(F.col("observed").isNull(), "no_statistic").otherwise("ok")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("exceedances", "used")]
    return frame.join(found, by, "left").select(*by, ok.alias("status"), "observed", "observed_at", *also, "p_value", *counts, "null_q95", "null_q99")


def enough(rows: DataFrame, keys: Sequence[str], least: int = 30) -> DataFrame:
    """(keys, status): insufficient_data for keys with fewer values than least."""
    return rows.groupBy(*keys).agg(F.when(F.count("value") < least, "insufficient_data").otherwise("ok").alias("status"))


def _testable(rows: DataFrame, keys: Sequence[str], status: DataFrame) -> DataFrame:
    """(keys, date, day, value) of the values of keys that can be tested."""
    live = with_day(rows.where("value IS NOT NULL")).select(*keys, "date", "day", "value")
    return live.join(status.where("status = 'ok'").select(*keys), list(keys), "left_semi")


def _best_bin(bins: DataFrame, keys: Sequence[str], bands: dict[str, tuple[int, int]], least_pairs: int) -> DataFrame:
    got = band_maximum(bins, keys, "lag_bin_center", "dcf", bands, least_pairs)
    return got.select(*keys, "band", F.col("dcf").alias("statistic"), F.col("lag_bin_center").cast("double").alias("at"))


def surrogate_bins(found: Surrogates, rows: DataFrame, lo: int, hi: int, width: int) -> DataFrame:
    """(keys, sim, lag_bin_center, pairs, dcf): autocorrelation DCF of surrogates on the days of rows, standardised each, lags pooled into bins from lo.

    Each day block takes the blocks that its lags reach; only sums per bin leave it.
    """
    keys, size = list(found.keys), hi - lo + 1
    days = rows.groupBy(*keys, F.floor(F.col("day") / BLOCK).alias("_of")).agg(F.sort_array(F.collect_list(F.col("day").cast("long"))).alias("_y"))
    reached = days.select(*keys, F.explode(F.sequence(F.col("_of") - (hi + BLOCK - 1) // BLOCK, F.col("_of") - lo // BLOCK)).alias("_of"), "_y")
    late = reached.groupBy(*keys, "_of").agg(F.flatten(F.collect_list("_y")).alias("_x"))
    n, starts = 1 << (2 * BLOCK + size).bit_length(), np.arange(0, size, width)

    def run(row: pd.Series, sims: np.ndarray, values: Callable) -> pd.DataFrame:
        base = int(row["_of"]) * BLOCK
        y = np.asarray(row["_y"], dtype=np.int64)
        x = np.asarray(row["_x"] if row["_x"] is not None else [], dtype=np.int64)
        x = x[(x >= base + lo) & (x < base + BLOCK + hi)]
        own = values(y)
        laid = np.zeros((2, len(sims) + 1, BLOCK + hi - lo))  # last row: which days are there
        for side, days, v in ((0, x - base - lo, values(x)), (1, y - base, own)):
            laid[side, :-1, days], laid[side, -1, days] = v.T, 1.0
        fx, fy = np.fft.rfft(laid[0], n), np.conj(np.fft.rfft(laid[1], n))
        pairs = np.rint(np.fft.irfft(fx[-1] * fy[-1], n)[:size])
        sums = [np.where(pairs > 0, np.fft.irfft(z, n)[:, :size], 0.0) for z in (fx[:-1] * fy[:-1], fx[:-1] * fy[-1], fx[-1] * fy[:-1])]
        pooled = [np.add.reduceat(z, starts, axis=1) for z in sums]
        lines = [np.hstack([m, z]) for m, z in zip(((own * own).sum(1)[:, None], own.sum(1)[:, None], np.zeros((len(sims), 1))), pooled)]
        count = np.concatenate([[len(y)], np.add.reduceat(pairs, starts)])
        return pd.DataFrame({"sim": np.repeat(sims, len(count)), "_b": np.tile(np.arange(-1, len(starts)), len(sims)), "pairs": np.tile(count, len(sims)), **dict(zip(("xy", "x", "y"), (z.ravel() for z in lines)))})

    sums = found.apply(days.join(late, [*keys, "_of"], "left"), run, "sim int, _b long, pairs double, xy double, x double, y double")
    total = sums.groupBy(*keys, "sim", "_b").agg(*(F.sum(c).alias(c) for c in ("pairs", "xy", "x", "y")))
    whole = F.max(F.when(F.col("_b") == -1, F.struct("pairs", "x", "xy"))).over(Window.partitionBy(*keys, "sim"))
    mean = F.col("_m.x") / F.col("_m.pairs")
    spread = F.col("_m.xy") / F.col("_m.pairs") - mean * mean
    product = F.try_divide(F.col("xy") - mean * (F.col("x") + F.col("y")) + F.col("pairs") * mean * mean, F.when(spread > 0, spread))
    centre = F.lit(lo) + F.col("_b") * width + (width - 1) / 2.0
    return total.withColumn("_m", whole).where("_b >= 0 AND pairs > 0").select(*keys, "sim", centre.alias("lag_bin_center"), F.col("pairs").cast("long").alias("pairs"), F.coalesce(product / F.col("pairs"), F.lit(0.0)).alias("dcf"))


def ar1_dcf_null(rows: DataFrame, keys: Sequence[str], bands: dict[str, tuple[int, int]], simulations: int = 499, lo: int = 250, hi: int = 600, width: int = 10, least_pairs: int = 100, seed: int = 1998) -> DataFrame:
    """Band maxima of the autocorrelation DCF against AR(1) surrogates on each key's observed days; surrogates are not detrended."""
    keys, status = list(keys), enough(rows, keys)
    live = _testable(rows, keys, status)
    observed = _best_bin(binned(discrete_correlation(live, live, keys, lo, hi, "raw"), keys, width, lo), keys, bands, least_pairs)
    found = surrogates(live, ar1_by_day(live, keys), keys, simulations, seed)
    null = _best_bin(surrogate_bins(found, live, lo, hi, width), [*keys, "sim"], bands, least_pairs)
    return tested(null, observed, status, keys, list(bands))


def _spans(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _first, _last, _missing) of the days that the sides 'a' and 'b' of rows share; _first may lie after _last."""
    ends = [f(F.when((F.col("side") == s) & F.col("value").isNotNull(), F.col("date"))) for s in "ab" for f in (F.min, F.max)]
    span = rows.groupBy(*keys).agg(*(e.alias(n) for e, n in zip(ends, ("_fa", "_la", "_fb", "_lb"))))
    return span.select(*keys, F.greatest("_fa", "_fb").alias("_first"), F.least("_la", "_lb").alias("_last"), (F.col("_fa").isNull() | F.col("_fb").isNull()).alias("_missing"))


_DAYS = "datediff(_last, _first) + 1"


def sides_in_span(rows: DataFrame, keys: Sequence[str], least_days: int = 1) -> DataFrame:
    """rows of the sides 'a' and 'b' within the days that both share, with _first and _last; none for keys with fewer such days."""
    limits = _spans(rows, keys).where(f"NOT _missing AND {_DAYS} >= {least_days}").drop("_missing")
    return rows.where("value IS NOT NULL").join(limits, list(keys)).where(F.col("date").between(F.col("_first"), F.col("_last")))


def _span_status(rows: DataFrame, keys: Sequence[str], least_days: int, short: str) -> DataFrame:
    """(keys, status) of the common span of the sides 'a' and 'b' of rows."""
    days = F.expr(_DAYS)
    return _spans(rows, keys).select(*keys, F.when(F.col("_missing"), "insufficient_data").when(days < 1, "no_overlap").when(days < least_days, short).otherwise("ok").alias("status"))


def drawn_shifts(spans: DataFrame, keys: Sequence[str], simulations: int, margin: int, seed: int) -> DataFrame:
    """(keys, sim, shift): shifts drawn with replacement from margin to n - margin, by the numbered noise, of spans (keys, n)."""

    def run(parts):
        for part in parts:
            for row in part.itertuples(index=False):
                room = row[-2] - 2 * margin + 1
                u = uniform(bits(row[-1], seed, np.arange(simulations), np.zeros(1, dtype=np.int64))[:, 0])
                yield pd.DataFrame({**dict(zip(keys, row)), "sim": np.arange(simulations), "shift": margin + np.floor(u * room).astype(int)})

    usable = spans.where(F.col("n") >= 2 * margin + 1).select(*keys, F.col("n").cast("long").alias("_n"), stream(keys).alias("_stream"))
    return usable.mapInPandas(run, f"{kinds(spans, keys)}sim int, shift long")


def circular_shift_null(rows: DataFrame, keys: Sequence[str], bands: dict[str, tuple[int, int]], simulations: int | None = 499, lo: int = 250, hi: int = 600, width: int = 10, least_pairs: int = 100, margin: int = 700, seed: int = 1998) -> DataFrame:
    """Band maxima of the cross DCF of sides 'a' and 'b' against b rolled around the common span.

    The statistic is taken at every shift from margin to the span less margin; the null is
    all of them (simulations None), or that many drawn with replacement.
    """
    keys = list(keys)
    status = _span_status(rows, keys, 2 * margin + 1, "span_too_short_for_shift_null")
    live = sides_in_span(rows, keys, 2 * margin + 1)
    z = standardised(live, [*keys, "side"]).withColumns({"n": F.datediff("_last", "_first") + 1, "i": F.datediff("date", "_first")})
    a, b = (z.where(F.col("side") == s).select(*keys, "n", "i", "date", "value") for s in "ab")
    observed = _best_bin(binned(dcf_of_standardised(with_day(a), with_day(b), keys, lo, hi), keys, width, lo), keys, bands, least_pairs)
    null = _best_bin(rotated_bins(a, b, keys, lo, hi, width, margin), [*keys, "shift"], bands, least_pairs)
    if simulations is not None:
        null = drawn_shifts(z.select(*keys, "n").distinct(), keys, simulations, margin, seed).join(null, [*keys, "shift"])
    return tested(null, observed, status, keys, list(bands))


def surrogate_spectra(found: Surrogates, placed: DataFrame, grid: waves.Grid, windows: waves.Windows | waves.YearWindows | waves.Whole, linear: bool, least: int, at: str = "day") -> DataFrame:
    """(keys, sim, the windows' columns, period_days, power) of surrogates on the days of placed rows (keys, _pane, day, and at, by which the recurrence runs).

    A batch's moments of a pane travel as one row; a group adds up the panes of one series and batch.
    """
    keys = list(found.keys)
    by = [*keys, "_pane", *(["_panes"] if "_panes" in placed.columns else [])]
    units = placed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(at).cast("long").alias("p"), F.col("day").cast("double").alias("t")))).alias("_d")).select(*by, F.col("_d.p").alias("_p"), F.col("_d.t").alias("_t"))
    more = by[len(keys) :]

    def run(row: pd.Series, sims: np.ndarray, values: Callable) -> pd.DataFrame:
        got = waves.moments(np.asarray(row["_t"]), values(np.asarray(row["_p"], dtype=np.int64)), grid)
        return pd.DataFrame({**{c: [row[c]] for c in more}, "_from": [sims[0]], "_sums": [got.tobytes()]})

    def windowed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sums, periods, out = {}, 1 / grid.values(), []
        for pane, packed in zip(part["_pane"], part["_sums"]):
            sums[pane] = np.frombuffer(packed).reshape(len(waves.MOMENTS), -1, grid.n)
        for w, (a, b) in enumerate(windows.spans(part)):
            some = [sums[p] for p in range(a, b) if p in sums]
            if some:
                p = waves.power(np.sum(some, axis=0), False, linear, least)
                sim, k = np.nonzero(np.isfinite(p))
                out.append(pd.DataFrame({**dict(zip(keys, key)), "sim": key[-1] + sim, **windows.columns(w), "period_days": periods[k], "power": p[sim, k]}))
        return pd.concat(out) if out else pd.DataFrame()

    per_pane = found.apply(units, run, f"{kinds(placed, more)}_from int, _sums binary")
    return per_pane.groupBy(*keys, "_from").applyInPandas(windowed, f"{kinds(placed, keys)}sim int, {windows.schema()}period_days double, power double")


def _largest(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = F.max_by("period_days", F.struct("power", -F.col("period_days")))
    return spectrum.groupBy(*keys).agg(F.max("power").alias("statistic"), best.alias("at")).withColumn("band", F.lit("band"))


def ar1_spectral_null(rows: DataFrame, keys: Sequence[str], band: tuple[float, float], simulations: int = 1999, detrend: str = "none", periods: int = 96, seed: int = 1998) -> DataFrame:
    """Band maxima of the spectrum on evenly spaced periods against AR(1) surrogates, detrended as the data; phi is that of the data as they are."""
    keys, status = list(keys), enough(rows, keys)
    live, grid, whole = _testable(rows, keys, status), waves.period_grid(*band, periods), waves.Whole()
    observed = _largest(waves.spectra(live, keys, grid, linear=DETREND[detrend], least=30), keys)
    found = surrogates(live, ar1_by_day(live, keys), keys, simulations, seed)
    null = surrogate_spectra(found, waves.by_pane(live, whole), grid, whole, DETREND[detrend], 30)
    return tested(_largest(null, [*keys, "sim"]), observed, status, keys, ["band"])


def red_noise_null(rows: DataFrame, keys: Sequence[str], band: tuple[float, float], simulations: int = 500, frequencies: int = 800, seed: int = 1998) -> DataFrame:
    """Band maxima on evenly spaced frequencies against AR(1) surrogates by row position that start from 0; values are detrended before phi is fitted."""
    keys, status = list(keys), enough(rows, keys)
    grid, whole = waves.frequency_grid(*band, frequencies), waves.Whole()
    flat = indexed(detrended(_testable(rows, keys, status), keys, "linear"), keys)
    observed = _largest(waves.spectra(flat, keys, grid, linear=False, least=30), keys)
    found = surrogates(flat, ar1_by_row(flat, keys), keys, simulations, seed, stationary=False, at="i")
    null = surrogate_spectra(found, waves.by_pane(flat, whole), grid, whole, False, 30, at="i")
    return tested(_largest(null, [*keys, "sim"]), observed, status, keys, ["band"])


def joint_powers(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, window, period_days, a, b, joint) of spectra (keys, side, window, period_days, power) where both sides have one; joint is the root of the product."""
    each = spectrum.groupBy(*keys, "window", "period_days").agg(*(F.max(F.when(F.col("side") == s, F.col("power"))).alias(s) for s in "ab"))
    zero = F.lit(0.0)
    return each.where("a IS NOT NULL AND b IS NOT NULL").withColumn("joint", F.sqrt(F.greatest(zero, F.col("a")) * F.greatest(zero, F.col("b"))))


def _joint_maxima(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, band, statistic, at, window) of the largest power of a, b and both; the first window and the longest period of equal ones."""
    place = lambda c: F.max_by(F.struct(F.col("period_days").alias("at"), "window"), F.struct(c, -F.col("window"), F.col("period_days")))
    best = [F.struct(F.lit(c).alias("band"), F.max(c).alias("statistic"), place(c).alias("of")) for c in ("a", "b", "joint")]
    return joint_powers(spectrum, keys).groupBy(*keys).agg(F.array(*best).alias("_best")).select(*keys, F.inline("_best")).select(*keys, "band", "statistic", "of.*")


def joint_null(rows: DataFrame, keys: Sequence[str], band: tuple[float, float], simulations: int = 1999, detrend: str = "none", periods: int = 96, years: int = 8, step: int = 2, least: int = 180, seed: int = 1998) -> DataFrame:
    """Largest power over calendar windows and periods of sides 'a', 'b' and of both together (root of the product), against independent AR(1) surrogates.

    Windows of so many years begin every ``step`` years from the first common day and lie
    in the common span; those with fewer than least values on a side are left out.
    """
    keys, grid, wins = list(keys), waves.period_grid(*band, periods), waves.YearWindows(years, step)
    status = _span_status(rows, keys, 365 * years, "insufficient_window_data")
    live = sides_in_span(rows, keys, 365 * years)
    both = [*keys, "side"]
    observed = _joint_maxima(waves.spectra(live, both, grid, wins, linear=DETREND[detrend], least=least), keys)
    start = lambda years: F.add_months("_first", (12 * years).cast("int"))
    ends = {"window_start": start(F.col("window") * step), "window_stop": F.date_sub(start(F.col("window") * step + years), 1)}
    observed = observed.join(_spans(rows, keys).select(*keys, "_first"), keys).withColumns(ends).drop("_first", "window")
    placed = with_day(live)
    found = surrogates(placed, ar1_by_day(live, both), both, simulations, seed)
    null = surrogate_spectra(found, waves.by_pane(live, wins), grid, wins, DETREND[detrend], least)
    return tested(_joint_maxima(null, [*keys, "sim"]), observed, status, keys, ["a", "b", "joint"], ["window_start", "window_stop"])
