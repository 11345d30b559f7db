"""Dates in archival encodings: two-digit decimal years and year with day of year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_year(y: Column) -> Column:
    """Rounded year; 0 to 99 count from 1900."""
    y = F.rint(y).cast("int")
    return F.when((y >= 0) & (y < 100), y + 1900).otherwise(y)


def from_decimal_year(v: Column, last_day: int = 365) -> Column:
    """YY.fraction with a fraction of day / 365, also in leap years.

    last_day 365: a year under 100 counts from 1900.  last_day 366: only 0 to 99 do.
    """
    yy = F.floor(v)
    year = F.when(yy >= 100, yy).otherwise(yy + 1900) if last_day == 365 else F.when((yy >= 0) & (yy < 100), yy + 1900).otherwise(yy)
    day = F.greatest(F.least(F.rint((v - yy) * 365.0).cast("int"), F.lit(last_day)), F.lit(1))
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), day - 1)


def to_decimal_year(date: Column) -> Column:
    """year % 100 + day of year / 365."""
    return F.year(date) % 100 + F.dayofyear(date) / F.lit(365.0)


def from_year_day(year: Column, day: Column) -> Column:
    """Year and day of year; a day outside 1 to 366 fails."""
    d = F.rint(day).cast("int")
    checked = F.when((d >= 1) & (d <= 366), d).otherwise(F.raise_error(F.concat(F.lit("day of year out of range: "), d.cast("string"))).cast("int"))
    return F.to_date(F.format_string("%04d%03d", expand_year(year), checked), "yyyyDDD")


#: Names of columns that hold a date, in order of preference, and of year and day columns.
DATE_NAMES = ("date", "datetime", "time", "epoch", "timestamp")
YEAR_NAMES = ("YEAR", "YYYY")
DAY_NAMES = ("DOY", "DAY", "DAY_OF_YEAR")


def with_date(rows: DataFrame) -> DataFrame:
    """rows with a column date: from a date column, a decimal year, or year and day of year, whichever comes first."""
    lower = {c.lower(): c for c in rows.columns}
    upper = {c.strip().upper(): c for c in reversed(rows.columns)}
    for name in DATE_NAMES:
        if name in lower:
            return rows.withColumn("date", F.try_to_timestamp(F.col(f"`{lower[name]}`").cast("string")).cast("date"))
    if "time_decimal_year" in rows.columns:
        return rows.withColumn("date", from_decimal_year(F.expr("try_cast(time_decimal_year AS double)")))
    year, day = next((upper[n] for n in YEAR_NAMES if n in upper), None), next((upper[n] for n in DAY_NAMES if n in upper), None)
    if year and day:
        y, d = F.expr(f"try_cast(`{year}` AS int)"), F.expr(f"try_cast(`{day}` AS int)")
        ok = y.between(1, 9999) & d.between(1, 366)
        first = F.make_date(F.when(ok, y), F.lit(1), F.lit(1))
        date = F.date_add(first, F.when(ok, d) - 1)
        return rows.withColumn("date", F.when(F.year(date) == y, date))
    raise ValueError("no date: need a date column, time_decimal_year, or year and day of year")
