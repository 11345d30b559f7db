"""Sums of waves over irregular days: moments per pane of time, added up to windows.

A sum over rows at evenly spaced frequencies is taken by extirpolation: each row is
spread over a few neighbours of a grid with a Kaiser-Bessel kernel, one Fourier
transform gives all frequencies, and the kernel's own transform is divided out (to about
1e-12 of the sum of absolute values).  Few or uneven frequencies are summed directly.

Moments are additive, so they are kept once per pane, a stretch of days that no window
cuts, and added up to windows of every length; a row enters one pane however many
windows hold it.  Removing a mean or a line is done on the moments.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import kinds

#: Days of a pane where no windows are asked for, and frequencies that are added up in one group.
PANE, CHUNK = 1024, 512
#: Grid points over which a row is spread.
WIDTH = 14
EPOCH = date(1970, 1, 1)


class Grid(NamedTuple):
    """Frequencies: first + k * step for k under n, or the reciprocals of n periods first + k * step."""

    first: float
    step: float
    n: int
    periods: bool = False

    def values(self) -> np.ndarray:
        x = self.first + np.arange(self.n) * self.step
        return 1 / x if self.periods else x


def frequency_grid(lo_period: float, hi_period: float, n: int) -> Grid:
    """n frequencies from 1 / hi_period to 1 / lo_period, evenly spaced."""
    a, b = 1.0 / hi_period, 1.0 / lo_period
    return Grid(a, (b - a) / (n - 1) if n > 1 else 0.0, n)


def period_grid(lo_period: float, hi_period: float, n: int) -> Grid:
    """Frequencies of n evenly spaced periods."""
    return Grid(float(lo_period), (hi_period - lo_period) / (n - 1) if n > 1 else 0.0, n, periods=True)


def wave_sums(t: np.ndarray, weights: np.ndarray, grid: Grid, times: int = 1) -> np.ndarray:
    """Sums over rows of weights (one row of them per sum) times exp(-2 pi i f t), at the grid's frequencies or a multiple of them."""
    if grid.periods or grid.n * len(t) < 1 << 15:
        return weights @ np.exp(-2j * math.pi * np.outer(t, times * grid.values()))
    return extirpolated(t, weights, times * grid.first, times * grid.step, grid.n)


def extirpolated(t: np.ndarray, weights: np.ndarray, first: float, step: float, n: int) -> np.ndarray:
    """The sums at first + k * step, k under n, by spreading rows over a grid (see the module's text)."""
    m = 1 << max(2 * n, 2 * WIDTH).bit_length()
    middle = n // 2
    turned = weights * np.exp(-2j * math.pi * (first + middle * step) * t)
    place = step * t % 1.0 * m
    left = np.ceil(place - WIDTH / 2)
    at = left[:, None] + np.arange(WIDTH)
    beta = math.pi * math.sqrt((WIDTH * 0.75) ** 2 - 0.8)
    kernel = np.i0(beta * np.sqrt(np.maximum(0.0, 1 - (2 * (place[:, None] - at) / WIDTH) ** 2))) / np.i0(beta)
    slot = (at.astype(np.int64) % m).ravel()
    grids = [np.bincount(slot, (w[:, None] * kernel).ravel().real, m) + 1j * np.bincount(slot, (w[:, None] * kernel).ravel().imag, m) for w in turned]
    k = np.arange(n) - middle
    root = np.sqrt(beta**2 - (math.pi * WIDTH * k / m) ** 2)
    return np.fft.fft(np.array(grids), axis=1)[:, k % m] / (WIDTH * np.sinh(root) / (root * np.i0(beta)))


#: Moments of the values y at days t, and of waves c = cos, s = sin of a frequency.
SCALARS = ("n", "y1", "yy", "t1", "tt", "ty")
MOMENTS = (*SCALARS, "c1", "s1", "cc", "ss", "cs", "yc", "ys", "tc", "ts")


def moments(t: np.ndarray, y: np.ndarray, grid: Grid) -> np.ndarray:
    """The MOMENTS (first axis) of every series of y (one a row, all at the days t), at every frequency of the grid."""
    one = wave_sums(t, np.vstack([np.ones(len(t)), t, y]), grid)
    twice = wave_sums(t, np.ones((1, len(t))), grid, 2)[0]
    n = float(len(t))
    waves = [one[0].real, -one[0].imag, (n + twice.real) / 2, (n - twice.real) / 2, -twice.imag / 2, one[2:].real, -one[2:].imag, one[1].real, -one[1].imag]
    plain = [n, y.sum(axis=1)[:, None], (y * y).sum(axis=1)[:, None], t.sum(), t @ t, (y @ t)[:, None]]
    return np.array([np.broadcast_to(x, (len(y), grid.n)) for x in (*plain, *waves)])


def power(sums: np.ndarray, floating_mean: bool, linear: bool, least: int) -> np.ndarray:
    """Lomb-Scargle power of moments (along the first axis), values about their mean or line; nan for fewer rows than least or no spread.

    floating_mean: the mean is fitted at every frequency (Zechmeister and Kuerster 2009).
    """
    m = dict(zip(MOMENTS, sums))
    with np.errstate(divide="ignore", invalid="ignore"):
        n = m["n"]
        spread = m["tt"] - m["t1"] ** 2 / n
        slope = np.where((n > 2) & (spread > 0), (m["ty"] - m["t1"] * m["y1"] / n) / spread, 0.0) if linear else np.zeros_like(n)
        level = (m["y1"] - slope * m["t1"]) / n
        yc, ys = m["yc"] - level * m["c1"] - slope * m["tc"], m["ys"] - level * m["s1"] - slope * m["ts"]
        yy = m["yy"] - level * m["y1"] - slope * m["ty"]
        cc, ss, cs = m["cc"], m["ss"], m["cs"]
        if floating_mean:
            cc, ss, cs = cc - m["c1"] ** 2 / n, ss - m["s1"] ** 2 / n, cs - m["c1"] * m["s1"] / n
        got = (ss * yc**2 + cc * ys**2 - 2 * cs * yc * ys) / (yy * (cc * ss - cs**2))
        # a spread below rounding noise of the sums is none
        return np.where((n >= least) & (yy > 1e-13 * m["yy"]), got, np.nan)


class Windows:
    """Windows of dates, both ends in, each with values of own columns; the panes between all their limits, and which panes make a window."""

    def __init__(self, windows: Sequence[tuple[date, date]], own: dict[str, Sequence] | None = None):
        self.own = own or {}
        self.days = [((a - EPOCH).days, (b - EPOCH).days) for a, b in windows]
        self.limits = sorted({x for a, b in self.days for x in (a, b + 1)})
        self.panes = [(self.limits.index(a), self.limits.index(b + 1)) for a, b in self.days]
        self.dates = list(windows)

    def placed(self, rows: DataFrame) -> DataFrame:
        limits = F.array(*(F.lit(x) for x in self.limits)).cast("array<int>")
        return rows.withColumn("_pane", F.size(F.filter(limits, lambda x: x <= F.col("day"))) - 1).where((F.col("_pane") >= 0) & (F.col("_pane") < len(self.limits) - 1))

    def spans(self, part: pd.DataFrame) -> list[tuple[int, int]]:
        return self.panes

    def schema(self) -> str:
        return "".join(f"{k} {'int' if isinstance(v[0], int) else 'string'}, " for k, v in self.own.items() if v) + "window_start date, window_stop date, "

    def columns(self, i: int) -> dict:
        return {k: v[i] for k, v in self.own.items()} | dict(zip(("window_start", "window_stop"), self.dates[i]))


class YearWindows(NamedTuple):
    """Windows of so many years that begin every step years from each key's own first day and end by its last: rows have _first and _last."""

    years: int
    step: int

    def placed(self, rows: DataFrame) -> DataFrame:
        months = 12 * math.gcd(self.years, self.step)
        whole = lambda day: F.floor(F.months_between(day, "_first", False) / months).cast("int")
        return rows.withColumn("_pane", whole(F.col("date"))).withColumn("_panes", whole(F.date_add("_last", 1))).where(F.col("date").between(F.col("_first"), F.col("_last")) & (F.col("_pane") < F.col("_panes")))

    def spans(self, part: pd.DataFrame) -> list[tuple[int, int]]:
        unit = math.gcd(self.years, self.step)
        long, every = self.years // unit, self.step // unit
        return [(a, a + long) for a in range(0, int(part["_panes"].iloc[0]) - long + 1, every)]

    def schema(self) -> str:
        return "window int, "

    def columns(self, i: int) -> dict:
        return {"window": i}


class Whole(NamedTuple):
    """No windows: all days, in panes of equal length."""

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_pane", F.floor(F.col("day") / PANE).cast("int"))

    def spans(self, part: pd.DataFrame) -> list[tuple[int, int]]:
        return [(int(part["_pane"].min()), int(part["_pane"].max()) + 1)]

    def schema(self) -> str:
        return ""

    def columns(self, i: int) -> dict:
        return {}


def by_pane(rows: DataFrame, windows: Windows | YearWindows | Whole) -> DataFrame:
    """rows with day and _pane; those in no window are left out."""
    return windows.placed(rows.withColumn("day", F.unix_date("date")))


def spectra(rows: DataFrame, keys: Sequence[str], grid: Grid, windows: Windows | YearWindows | None = None, floating_mean: bool = False, linear: bool = True, least: int = 10) -> DataFrame:
    """(keys, the windows' columns, period_days, power) of rows (keys, date, value), over all days or in each window."""
    windows = windows or Whole()
    live = by_pane(rows.where("value IS NOT NULL"), windows)
    by = [*keys, "_pane", *(["_panes"] if "_panes" in live.columns else [])]
    k = np.arange(grid.n, dtype=np.int32)

    def pane_moments(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        got = moments(part["day"].to_numpy(float), part["value"].to_numpy(float)[None, :], grid)[:, 0]
        return pd.DataFrame({**dict(zip(by, key)), "_k": k, **dict(zip((f"_{m}" for m in MOMENTS), got))})

    per_pane = live.select(*by, "day", "value").groupBy(*by).applyInPandas(pane_moments, f"{kinds(live, by)}_k int, {MOMENT_SCHEMA}")
    return of_moments(per_pane, keys, grid, windows, floating_mean, linear, least)


MOMENT_SCHEMA = ", ".join(f"_{m} double" for m in MOMENTS)


def of_moments(per_pane: DataFrame, keys: Sequence[str], grid: Grid, windows: Windows | YearWindows | Whole, floating_mean: bool, linear: bool, least: int) -> DataFrame:
    """(keys, the windows' columns, period_days, power) of moments (keys, _pane, _k, MOMENTS) added up to windows."""

    def windowed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        values, at, sums = grid.values(), *added(part, windows.spans(part), [f"_{m}" for m in MOMENTS])
        out = []
        for i, total in enumerate(sums):
            p = power(total, floating_mean, linear, least)
            good = np.isfinite(p)
            out.append(pd.DataFrame({**dict(zip(keys, key)), **windows.columns(i), "period_days": 1 / values[at[good]], "power": p[good]}))
        return pd.concat(out) if out else pd.DataFrame()

    return per_pane.groupBy(*keys, F.floor(F.col("_k") / CHUNK).alias("_chunk")).applyInPandas(windowed, f"{kinds(per_pane, keys)}{windows.schema()}period_days double, power double")


def added(part: pd.DataFrame, spans: Sequence[tuple[int, int]], columns: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The frequencies k of a group's panes, and the sums of the columns over each span of panes."""
    at, place = np.unique(part["_k"].to_numpy(), return_inverse=True)
    pane, first = part["_pane"].to_numpy(), int(part["_pane"].min())
    kept = np.zeros((int(pane.max()) - first + 1, len(columns), len(at)))
    np.add.at(kept, (pane - first, slice(None), place), part[list(columns)].to_numpy())
    return at, [kept[max(a - first, 0) : max(b - first, 0)].sum(axis=0) for a, b in spans]


def harmonics(n: int, lo: float, hi: float) -> Grid | None:
    """Harmonics of a span of n days whose periods lie from lo to hi; None where there are none."""
    low, top = max(1, math.ceil(n / hi)), min(n // 2, math.floor(n / lo))
    return Grid(low / n, 1 / n, top - low + 1) if low <= top else None


def sampling_power(count: np.ndarray, waves: np.ndarray, n: int, grid: Grid, least: int) -> np.ndarray:
    """One-sided power of the 0/1 availability of n days, its mean taken off; nan for spans or days under least, and where no day is missing."""
    k = np.rint(grid.values() * n)
    got = np.where(2 * k == n, 1.0, 2.0) * np.abs(waves) ** 2 / n / n
    return np.where((n >= least) & (count >= least) & (count < n), got, np.nan)


def sampling_in_windows(rows: DataFrame, keys: Sequence[str], lo: float, hi: float, windows: Windows, least: int = 10) -> DataFrame:
    """(keys, the windows' columns, period_days, power) of the availability of the days of rows (keys, date) in each window.

    Windows of equal length share their frequencies, which each pane sums once.
    """
    grids = {n: g for n in sorted({b - a + 1 for a, b in windows.days}) if (g := harmonics(n, lo, hi))}
    of = {n: [i for i, (a, b) in enumerate(windows.days) if b - a + 1 == n] for n in grids}
    live = by_pane(rows.select(*keys, "date"), windows)

    def pane_sums(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t, pane, out = part["day"].to_numpy(float), int(key[-1]), []
        for n, grid in grids.items():
            if any(windows.panes[i][0] <= pane < windows.panes[i][1] for i in of[n]):
                z = wave_sums(t, np.ones((1, len(t))), grid)[0]
                out.append(pd.DataFrame({**dict(zip([*keys, "_pane"], key)), "_days": n, "_k": np.arange(grid.n), "_m": float(len(t)), "_re": z.real, "_im": z.imag}))
        return pd.concat(out) if out else pd.DataFrame(columns=[*keys, "_pane", "_days", "_k", "_m", "_re", "_im"])

    def windowed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n, out = int(key[-1]), []
        at, sums = added(part, [windows.panes[i] for i in of[n]], ["_m", "_re", "_im"])
        for i, (m, re, im) in zip(of[n], sums):
            p = sampling_power(m, re + 1j * im, n, grids[n], least)
            good = np.isfinite(p)
            out.append(pd.DataFrame({**dict(zip(keys, key)), **windows.columns(i), "period_days": 1 / grids[n].values()[at[good]], "power": p[good]}))
        return pd.concat(out)

    per_pane = live.groupBy(*keys, "_pane").applyInPandas(pane_sums, f"{kinds(rows, keys)}_pane int, _days int, _k int, _m double, _re double, _im double")
    return per_pane.groupBy(*keys, "_days").applyInPandas(windowed, f"{kinds(rows, keys)}{windows.schema()}period_days double, power double")
