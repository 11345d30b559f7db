"""Column expressions: guarded arithmetic, statistics from sums, geometry and period context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres of an astronomical unit over the seconds of a day, in two roundings.
AU_DAY_FACTOR = 149597870.7 / 86400.0
AU_DAY_FACTOR_ROUNDED = 1731.0
DEFAULT_SPEED = 400.0


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def log10_positive(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, least: int = 3) -> Column:
    """Pearson correlation from sums; null for fewer than least pairs or no spread."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    # a spread below rounding noise of the sums is none
    spread = (vx > F.lit(1e-12) * sxx) & (vy > F.lit(1e-12) * syy)
    return F.when((n >= least) & spread, (sxy - sx * sy / n) / F.sqrt(vx * vy))


def radius(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def mean_speed(a: Column, b: Column, default: float = DEFAULT_SPEED) -> Column:
    """Mean of two speeds of which null and 0 count as unknown; the known one, or default, where not both are known."""
    a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return F.when((a != 0) & (b != 0), (a + b) / 2).when(a != 0, a).when(b != 0, b).otherwise(F.lit(default))


def delay_days(r_a: Column, r_b: Column, speed: Column, exact: bool = True) -> Column:
    """Whole days (half to even) that a flow of the speed needs between two radii; exact takes the rounded factor of the record."""
    return F.rint((r_a - r_b) / speed * (AU_DAY_FACTOR_ROUNDED if exact else AU_DAY_FACTOR)).cast("int")


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n)))).cast("long")


def historical_lag(lag: Column) -> Column:
    """The recorded sign convention: the lag of the correlation, negated."""
    return -lag


def rayleigh(signal: Column, window: Column, span: Column) -> Column:
    """Frequency separation of two periods in units of the resolution 1 / span; null unless all are positive."""
    return F.when((signal > 0) & (window > 0) & (span > 0), F.abs(1 / signal - 1 / window) * span)


def period_resolution(signal: Column, window: Column, span: Column) -> Column:
    """First-order width P^2 / T of one resolution unit in period."""
    return F.when((signal > 0) & (window > 0) & (span > 0), signal * signal / span)


def concordance(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Absolute difference of two periods, its ratio to their mean, and whether that is at most a tenth."""
    gap = F.abs(a - b)
    relative = ratio(gap, (a + b) / 2)
    return gap, relative, relative <= 0.1
