"""Spectra: classical and floating-mean Lomb-Scargle, sampling windows and Fourier transforms.

Lomb-Scargle spectra and sampling windows come from moments per pane of days (see
``waves``); bands of Fourier sums explode rows over the harmonics of the band.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import next_power_of_two
from . import waves
from .blocks import kinds
from .series import indexed, moments_joined, transformed
from .waves import Windows, frequency_grid, period_grid

#: Whether values are taken about their line, or about their mean.
DETREND = {"linear": True, "constant": False, "none": False}


def lomb_scargle_series(rows: DataFrame, keys: Sequence[str], lo: float = 20, hi: float = 4000, n: int = 10_000, detrend: str = "linear", windows: Windows | None = None) -> DataFrame:
    """Classical spectrum of raw values on a frequency grid, over all days or in each window."""
    return waves.spectra(rows, keys, frequency_grid(lo, hi, n), windows, linear=DETREND[detrend])


def lomb_scargle_log(rows: DataFrame, keys: Sequence[str], lo: float = 20, hi: float = 2500, n: int = 6_000, detrend: str = "linear", windows: Windows | None = None) -> DataFrame:
    """Floating-mean spectrum of log10 of the positive values on a frequency grid."""
    return waves.spectra(transformed(rows, "log10"), keys, frequency_grid(lo, hi, n), windows, floating_mean=True, linear=DETREND[detrend])


def lomb_scargle_periods(rows: DataFrame, keys: Sequence[str], lo: float, hi: float, n: int = 96, detrend: str = "none", least: int = 30, windows: Windows | None = None, transform: str = "log10") -> DataFrame:
    """Classical spectrum of log10 of the positive values (or of the values as they are) on evenly spaced periods."""
    return waves.spectra(transformed(rows, transform), keys, period_grid(lo, hi, n), windows, linear=DETREND[detrend], least=least)


def sampling_window(rows: DataFrame, keys: Sequence[str], lo: float, hi: float, positive: bool = False, limits: DataFrame | None = None, least: int = 10) -> DataFrame:
    """(keys, period_days, power) of the 0/1 availability of days over each key's span, or limits (keys, first, last).

    Harmonics k of the N-day span with lo <= N / k <= hi; one-sided power, the mean taken off.  Only observed days
    enter, since a full period of ones sums to 0.  None for spans or observations under least, or days all present.
    """
    live = rows.where("value > 0" if positive else "value IS NOT NULL").select(*keys, "date")
    placed = moments_joined(live, live, keys, {"first": F.min("date"), "last": F.max("date")}) if limits is None else live.join(limits, list(keys))
    within = placed.where(F.col("date").between(F.col("first"), F.col("last"))).select(*keys, (F.datediff("last", "first") + 1).cast("long").alias("_n"), F.datediff("date", "first").cast("long").alias("_d"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n, t = int(key[-2]), part["_d"].to_numpy(float)
        grid = waves.harmonics(n, lo, hi)
        if grid is None:
            return pd.DataFrame(columns=[*keys, "_n", "_k", "_m", "_re", "_im"])
        z = waves.wave_sums(t, np.ones((1, len(t))), grid)[0]
        return pd.DataFrame({**dict(zip([*keys, "_n"], key)), "_k": np.rint(grid.values() * n).astype(int), "_m": len(t), "_re": z.real, "_im": z.imag})

    sums = within.groupBy(*keys, "_n", F.floor(F.col("_d") / waves.PANE).alias("_pane")).applyInPandas(run, f"{kinds(live, keys)}_n long, _k long, _m long, _re double, _im double")
    got = sums.groupBy(*keys, "_n", "_k").agg(*(F.sum(c).alias(c) for c in ("_m", "_re", "_im")))
    one_sided = F.when(F.col("_k") * 2 == F.col("_n"), 1.0).otherwise(2.0)
    live_keys = (F.col("_n") >= least) & (F.col("_m") >= least) & (F.col("_m") < F.col("_n"))
    return got.where(live_keys).select(*keys, (F.col("_n") / F.col("_k")).alias("period_days"), (one_sided * (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")) / F.col("_n") / F.col("_n")).alias("power"))


def fourier_band(rows: DataFrame, keys: Sequence[str], lo: float, hi: float) -> DataFrame:
    """(keys, frequency_cpd, period_days, power, phase_deg) of positions zero-padded to a power of two, for periods in the band."""

    placed = indexed(rows.where("value IS NOT NULL"), keys)
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_m")).where("_m >= 4").withColumn("_n", next_power_of_two(F.col("_m")))
    low, top = F.greatest(F.lit(1), F.ceil(F.col("_n") / hi)).cast("long"), F.least(F.col("_n") / 2 - 1, F.floor(F.col("_n") / lo)).cast("long")
    waves = placed.join(sizes, list(keys)).where(low <= top).select(*keys, "_n", "i", "value", F.explode(F.sequence(low, top)).alias("_k"))
    angle = F.lit(2 * math.pi) * (F.pmod(F.col("_k") * F.col("i"), F.col("_n")) / F.col("_n"))
    got = waves.groupBy(*keys, "_n", "_k").agg(F.sum(F.col("value") * F.cos(angle)).alias("_re"), (-F.sum(F.col("value") * F.sin(angle))).alias("_im"))
    return got.select(*keys, (F.col("_k") / F.col("_n")).alias("frequency_cpd"), (F.col("_n") / F.col("_k")).alias("period_days"), (2 * (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im"))).alias("power"), F.degrees(F.atan2("_im", "_re")).alias("phase_deg"))


def fourier_full(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All positive frequencies of fourier_band, with an FFT per key in a grouped map."""
    kept = rows.where("value IS NOT NULL").select(*keys, "date", "value")

    def transform(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("date")["value"].to_numpy(float)
        if len(x) < 4:
            return pd.DataFrame(columns=[*keys, "frequency_cpd", "period_days", "power", "phase_deg"])
        n = 1 << (len(x) - 1).bit_length()
        z = np.fft.rfft(x, n)[1 : n // 2]
        f = np.arange(1, n // 2) / n
        return pd.DataFrame({**dict(zip(keys, key)), "frequency_cpd": f, "period_days": 1 / f, "power": 2 * np.abs(z) ** 2, "phase_deg": np.degrees(np.angle(z))})

    kinds = ", ".join(f"`{k}` {dict(kept.dtypes)[k]}" for k in keys)
    return kept.groupBy(*keys).applyInPandas(transform, f"{kinds}, frequency_cpd double, period_days double, power double, phase_deg double")
