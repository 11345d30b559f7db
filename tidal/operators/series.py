"""The series model: rows (keys..., date, value), one per key and date, and operators on it.

day is the number of days since 1970-01-01.  Nothing is interpolated: gaps are
absent rows, or null values where a dense grid is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, log10_positive


def to_long(wide: DataFrame, channels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Wide rows as (keys, channel, date, value), null and non-finite values dropped."""
    kept = wide.select(*keys, "date", *(F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in channels))
    long = kept.unpivot([*keys, "date"], list(channels), "channel", "value")
    return long.select(*keys, "channel", F.col("date").cast("date").alias("date"), finite(F.col("value")).alias("value")).where("date IS NOT NULL AND value IS NOT NULL")


def one_per_date(rows: DataFrame, keys: Sequence[str], on_duplicate: str = "error", order: Sequence[str] = ()) -> DataFrame:
    """(keys, date, value) with one row a date: error fails on a second one, first keeps the first by order, mean averages."""
    by = [*keys, "date"]
    if on_duplicate == "mean":
        return rows.groupBy(*by).agg(F.avg("value").alias("value"))
    if on_duplicate == "first":
        columns = [F.col(c) for c in (order or ("value",))]
        return rows.groupBy(*by).agg(F.min_by("value", F.struct(*columns)).alias("value"))
    if on_duplicate == "error":
        n = F.count("*")
        checked = F.when(n > 1, F.raise_error(F.lit("duplicate dates in a series")).cast("double")).otherwise(F.first("value"))
        return rows.groupBy(*by).agg(checked.alias("value"))
    raise ValueError(f"unknown policy {on_duplicate!r}")


def day_number(c: str | Column = "date") -> Column:
    return F.unix_date(F.col(c) if isinstance(c, str) else c)


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", day_number())


def quality_mask(rows: DataFrame, affected: Column, cutoff: str) -> DataFrame:
    """value is null for affected rows from the cutoff date on; rows stay."""
    return rows.withColumn("value", F.when(~(affected & (F.col("date") >= F.lit(cutoff).cast("date"))), F.col("value")))


def transformed(rows: DataFrame, transform: str) -> DataFrame:
    """value as it is (raw) or its log10 where positive (log10)."""
    if transform == "raw":
        return rows.where("value IS NOT NULL")
    if transform == "log10":
        return rows.where("value > 0").withColumn("value", log10_positive(F.col("value")))
    raise ValueError(f"unknown transform {transform!r}")


def moments_joined(rows: DataFrame, of: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """rows with aggregates of another frame's rows of the same keys, partially aggregated and joined back; without keys they are one row."""
    got = of.groupBy(*keys).agg(*(c.alias(n) for n, c in sums.items()))
    if not keys:
        return rows.withColumn("_one", F.lit(1)).join(F.broadcast(got.withColumn("_one", F.lit(1))), "_one").drop("_one")
    named = got.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return rows.join(named, same).drop(*(f"_of_{k}" for k in keys))


def detrended(rows: DataFrame, keys: Sequence[str], mode: str, column: str = "value", x: str = "day", more_than: int = 2) -> DataFrame:
    """column less its mean (constant), less its line over x (linear, given more than so many rows), or as it is (none)."""
    if mode == "none":
        return rows
    if mode not in ("linear", "constant"):
        raise ValueError(f"unknown detrend {mode!r}")
    y, t = F.col(column), F.col(x).cast("double")
    known = F.when(y.isNotNull(), t)
    sums = {"_n": F.count(y), "_y": F.avg(y), "_t": F.avg(known), "_slope": F.try_divide(F.covar_pop(y, known), F.var_pop(known))}
    base = moments_joined(rows, rows, keys, sums)
    level = y - F.col("_y")
    if mode == "linear":
        level = F.when(F.col("_n") > more_than, level - F.coalesce("_slope", F.lit(0.0)) * (t - F.col("_t"))).otherwise(y)
    return base.withColumn(column, level).drop(*sums)


def standardised(rows: DataFrame, keys: Sequence[str], column: str = "value") -> DataFrame:
    """column as a z-score over each key (population spread); 0 without spread, unchanged for a single value."""
    sums = {"_m": F.avg(column), "_s": F.stddev_pop(column), "_n": F.count(column)}
    z = F.coalesce(F.try_divide(F.col(column) - F.col("_m"), F.col("_s")), F.lit(0.0))
    return moments_joined(rows, rows, keys, sums).withColumn(column, F.when(F.col("_n") < 2, F.col(column)).otherwise(z)).drop(*sums)


def within(rows: DataFrame, start: str | date, stop: str | date) -> DataFrame:
    return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(stop).cast("date")))


def spans(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, first, last, n) of the dates with a value."""
    return rows.where("value IS NOT NULL").groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


def common_span(rows: DataFrame, keys: Sequence[str], over: Sequence[str] = ()) -> DataFrame:
    """(over, first, last): the dates that all keys' spans share, empty where they don't meet."""
    each = spans(rows, keys)
    return each.groupBy(*over).agg(F.max("first").alias("first"), F.min("last").alias("last")).where("first <= last")


def aligned(a: DataFrame, b: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Rows of the dates on which both have a value: date, a, b and the extra columns of each with _a and _b."""
    left = a.where("value IS NOT NULL").select("date", F.col("value").alias("a"), *(F.col(c).alias(f"{c}_a") for c in extra))
    right = b.where("value IS NOT NULL").select("date", F.col("value").alias("b"), *(F.col(c).alias(f"{c}_b") for c in extra))
    return left.join(right, "date")


def indexed(rows: DataFrame, keys: Sequence[str] = (), order: str = "date") -> DataFrame:
    """rows with i, their position from 0 by date within each key."""
    return rows.withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def dense_grid(rows: DataFrame, keys: Sequence[str], limits: DataFrame | None = None) -> DataFrame:
    """(keys, date, value) for every day of each key's span, or of limits (keys, first, last); value is null in gaps."""
    limits = spans(rows, keys).select(*keys, "first", "last") if limits is None else limits
    days = limits.select(*keys, F.explode(F.sequence("first", "last")).alias("date"))
    return days.join(rows.select(*keys, "date", "value"), [*keys, "date"], "left")


def assembled(main: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """main left-joined to other on date; absent columns are null, a decimal year is added, columns in order."""
    from ..functions.dates import to_decimal_year

    joined = main.join(other, "date", "left")
    joined = joined.withColumn("time_decimal_year", to_decimal_year(F.col("date")))
    return joined.select("date", "time_decimal_year", *(F.col(c) if c in joined.columns else F.lit(None).cast("double").alias(c) for c in columns))


def add_years(d: date, years: int) -> date:
    """The same day years on; 29 February becomes 28 where there is none."""
    try:
        return d.replace(year=d.year + years)
    except ValueError:
        return d.replace(year=d.year + years, day=28)


def calendar_windows(start: date, stop: date, years: int, step: int = 1) -> list[tuple[date, date]]:
    """Inclusive windows of whole years that end by stop; starts advance by repeated steps."""
    out, at = [], start
    while (end := add_years(at, years) - timedelta(days=1)) <= stop:
        out.append((at, end))
        at = add_years(at, step)
    return out


def windows_frame(spark: SparkSession, windows: Sequence[tuple[date, date]], **constants) -> DataFrame:
    """(window_start, window_stop, constants) as a small table."""
    rows = [(a, b, *constants.values()) for a, b in windows]
    kind = "".join(f", {k} {'int' if isinstance(v, int) else 'string'}" for k, v in constants.items())
    return spark.createDataFrame(rows, "window_start date, window_stop date" + kind)


def in_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Each row once for every window that holds its date; the windows are a handful of calendar ranges."""
    return rows.join(F.broadcast(windows), F.col("date").between(F.col("window_start"), F.col("window_stop")))
