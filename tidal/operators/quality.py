"""Completeness and spacing reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_means(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of every column by date, nulls skipped."""
    return rows.groupBy("date").agg(*(F.avg(c).alias(c) for c in columns))


def positive_daily_mean(rows: DataFrame, time: str, value: str) -> DataFrame:
    """(date, value, n): mean of the positive values of a day."""
    positive = F.when(F.col(value) > 0, F.col(value))
    return rows.groupBy(F.to_date(time).alias("date")).agg(F.avg(positive).alias("value"), F.count(positive).alias("n"))


def field_summary(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, rows, finite, missing, zeros); an infinite value is neither finite nor missing."""
    long = rows.select(*(F.col(f).cast("double").alias(f) for f in fields)).unpivot([], list(fields), "field", "value")
    missing = F.col("value").isNull() | F.isnan("value")
    return long.groupBy("field").agg(
        F.count("*").alias("rows"),
        F.count_if(~missing & (F.abs("value") != float("inf"))).alias("finite"),
        F.count_if(missing).alias("missing"),
        F.count_if(F.col("value") == 0).alias("zeros"),
    )


def series_report(rows: DataFrame, keys: Sequence[str], reference_rows: int) -> DataFrame:
    """Per key: rows, finite, missing, zeros, first and last date, span in days, and whether rows reach the reference count and every day has a value."""
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count("value").alias("finite"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.count_if(F.col("value") == 0).alias("zeros"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    span = (F.datediff("last_date", "first_date") + 1).cast("long")
    return out.withColumn("span_days", span).withColumn("matches_reference", F.col("rows") == reference_rows).withColumn("complete", F.col("finite") == F.col("span_days"))


def spacing(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Steps between consecutive dates of each key: counts, gaps, longest, mean and median step."""
    step = F.datediff("date", F.lag("date").over(Window.partitionBy(*keys).orderBy("date")))
    return rows.withColumn("step", step).groupBy(*keys).agg(
        F.count("*").alias("common_rows"), F.min("date").alias("start_date"), F.max("date").alias("stop_date"),
        F.datediff(F.max("date"), F.min("date")).cast("long").alias("calendar_span_days"),
        F.count_if(F.col("step") == 1).alias("one_day_steps"), F.count_if(F.col("step") > 1).alias("gaps_gt_1_day"),
        F.coalesce(F.max("step"), F.lit(0)).cast("long").alias("max_gap_days"), F.avg("step").alias("mean_step_days"), F.expr("percentile(step, 0.5)").alias("median_step_days"),
    )


def lag_separation(rows: DataFrame, lags: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Calendar days between dates so many rows apart: pairs, mean, median, least and largest for each lag."""
    order = Window.partitionBy(*keys).orderBy("date")
    placed = rows.select(*keys, "date", F.row_number().over(order).alias("i"))
    ahead = placed.select(*keys, F.explode(F.array(*map(F.lit, lags))).alias("sample_lag"), F.col("i"), "date")
    later = placed.select(*keys, F.col("i").alias("j"), F.col("date").alias("later"))
    on = (F.col("i") + F.abs("sample_lag") == F.col("j")) if not keys else None
    pairs = ahead.join(later, on) if on is not None else ahead.withColumn("j", F.col("i") + F.abs("sample_lag")).join(later, [*keys, "j"])
    gap = F.datediff("later", "date")
    found = pairs.where("sample_lag <> 0").groupBy(*keys, "sample_lag").agg(
        F.count("*").alias("pairs"), F.avg(gap).alias("mean_calendar_days"), F.percentile(gap, F.lit(0.5)).alias("median_calendar_days"),
        F.min(gap).cast("long").alias("min_calendar_days"), F.max(gap).cast("long").alias("max_calendar_days"),
    )
    every = (placed.select(*keys).distinct() if keys else rows.sparkSession.range(1).drop("id")).select(*keys, F.explode(F.array(*map(F.lit, lags))).alias("sample_lag"))
    return every.join(found, [*keys, "sample_lag"], "left").fillna(0, ["pairs"])


def has_geometry(rows: DataFrame, columns: Sequence[str]) -> Column | bool:
    """Aggregate: whether every column is there with a value."""
    if not set(columns) <= set(rows.columns):
        return F.lit(False)
    out = F.lit(True)
    for c in columns:
        out = out & (F.count(c) > 0)
    return out
