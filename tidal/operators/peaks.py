"""Local maxima, prominences, band maxima and their morphology, over profiles keyed by series.

A profile is rows (keys, x, y).  A local maximum is a run of equal values lower on
both sides, at its middle position (left of the middle if even); the ends of a
profile are never one.  Its prominence is its height over the higher of the two
least values met on the way to a strictly higher value, or to the end, on each side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def local_maxima(profile: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """profile with i, the position by x, and is_local_peak; rows with null y are left out."""
    order = Window.partitionBy(*keys).orderBy(x)
    placed = profile.where(F.col(y).isNotNull() & ~F.isnan(y)).withColumn("i", F.row_number().over(order).cast("long"))
    before = F.lag(y).over(order)
    runs = placed.withColumn("_run", F.sum(F.when(before.isNull() | (before != F.col(y)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_run")
    edges = runs.withColumn("_from", F.min("i").over(run)).withColumn("_to", F.max("i").over(run)).withColumn("_prev", before).withColumn("_next", F.lead(y).over(order))
    lower_left = F.min(F.when(F.col("i") == F.col("_from"), F.coalesce(F.col("_prev") < F.col(y), F.lit(False)))).over(run)
    lower_right = F.min(F.when(F.col("i") == F.col("_to"), F.coalesce(F.col("_next") < F.col(y), F.lit(False)))).over(run)
    middle = F.floor((F.col("_from") + F.col("_to")) / 2)
    return edges.withColumn("is_local_peak", lower_left & lower_right & (F.col("i") == middle)).drop("_run", "_from", "_to", "_prev", "_next")


def prominences(profile: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """profile with is_local_peak and prominence (0 where not a peak).

    Each profile, a bounded grid of lags or frequencies, is read once to each side in a grouped map.
    """
    placed = local_maxima(profile, keys, x, y)
    schema = StructType([*placed.schema.fields, StructField("prominence", DoubleType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        v = rows[y].to_numpy(dtype=float)
        base = np.maximum(_least_before_higher(v), _least_before_higher(v[::-1])[::-1])
        return rows.assign(prominence=np.where(rows["is_local_peak"].to_numpy(dtype=bool), v - base, 0.0))

    return placed.groupBy(*keys).applyInPandas(run, schema)


def _least_before_higher(v: np.ndarray) -> np.ndarray:
    """Of every value the least of those from it back to the next strictly higher one, which is left out."""
    out, held = v.copy(), []
    for i, value in enumerate(v.tolist()):
        least = value
        while held and held[-1][0] <= value:
            least = min(least, held.pop()[1])
        out[i] = least
        held.append((value, least))
    return out


def _best(rows: DataFrame, keys: Sequence[str], score: Column, x: str, others: Sequence[str]) -> DataFrame:
    """The row of largest score of each key; the least x on ties; null and NaN scores never win."""
    kept = rows.where(score.isNotNull() & ~F.isnan(score))
    row = F.max_by(F.struct(x, *others), F.struct(score.alias("s"), (-F.col(x)).alias("n")))
    return (kept.groupBy(*keys) if keys else kept.groupBy()).agg(row.alias("r")).where("r IS NOT NULL").select(*keys, "r.*")


def band_maximum(rows: DataFrame, keys: Sequence[str], x: str, y: str, bands: dict[str, tuple[float, float]], least_pairs: int | None = None, pairs: str = "pairs", absolute: bool = False, others: Sequence[str] = ()) -> DataFrame:
    """(keys, band, x, y, others) at the largest y, or |y|, with x in each band (both ends in) and enough pairs."""
    names = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for b, (lo, hi) in bands.items()))
    spread = rows.withColumn("_b", F.explode(names)).where(F.col(x).between(F.col("_b.lo"), F.col("_b.hi"))).withColumn("band", F.col("_b.band")).drop("_b")
    if least_pairs is not None:
        spread = spread.where(F.col(pairs) >= least_pairs)
    return _best(spread, [*keys, "band"], F.abs(y) if absolute else F.col(y), x, [y, *others])


def at_points(rows: DataFrame, keys: Sequence[str], x: str, points: Sequence[int], fill: dict | None = None) -> DataFrame:
    """rows at the given x, one for every key and point; nulls (or fill) where there is none."""
    wanted = rows.select(*keys).distinct().select(*keys, F.explode(F.array(*(F.lit(p).cast(dict(rows.dtypes)[x]) for p in points))).alias(x)) if keys else rows.sparkSession.range(1).select(F.explode(F.array(*(F.lit(p).cast(dict(rows.dtypes)[x]) for p in points))).alias(x))
    out = wanted.join(rows, [*keys, x], "left")
    return out.fillna(fill) if fill else out


def top_peaks(profile: DataFrame, keys: Sequence[str], x: str, y: str, n: int, by: Sequence[Column], only_peaks: bool = True) -> DataFrame:
    """The n first peaks of each key by the given order, with rank; all rows if a key has no peak and only_peaks is not set."""
    rows = prominences(profile, keys, x, y) if "prominence" not in profile.columns else profile
    some = F.max(F.col("is_local_peak")).over(Window.partitionBy(*keys))
    kept = rows.withColumn("_any", some).where(F.col("is_local_peak") if only_peaks else F.col("is_local_peak") | ~F.col("_any")).drop("_any")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long")).where(F.col("rank") <= n)


def correlation_peaks(correlation: DataFrame, n: int = 12, min_abs_lag: int = 1) -> DataFrame:
    """(lag_days, coefficient, rank): local maxima among lags of min_abs_lag or more; all such lags if there is none."""
    q = local_maxima(correlation.where(F.abs("lag_days") >= min_abs_lag), [], "lag_days", "coefficient").withColumn("prominence", F.lit(0.0))
    return top_peaks(q, [], "lag_days", "coefficient", n, [F.desc("coefficient"), F.asc("lag_days")], only_peaks=False).select("lag_days", "coefficient", "rank")


def positive_lag_peaks(correlation: DataFrame, threshold: float = 0.1, n: int = 20) -> DataFrame:
    """(lag_days, coefficient): local maxima among positive lags that reach the threshold, so neighbours may lie apart; the largest rows if fewer than 3."""
    q = correlation.where((F.col("lag_days") > 0) & (F.col("coefficient") >= threshold))
    rows = local_maxima(q, [], "lag_days", "coefficient").withColumn("_n", F.count("*").over(Window.partitionBy()))
    kept = rows.where(F.col("is_local_peak") | (F.col("_n") < 3))
    return kept.orderBy(F.desc("coefficient"), "lag_days").limit(n).select("lag_days", "coefficient")


def lag_morphology(profile: DataFrame, keys: Sequence[str], bands: dict[str, tuple[int, int]], least_pairs: int = 100) -> DataFrame:
    """Band maximum of a binned DCF with at_band_edge (within half a bin), is_local_peak and prominence over the whole profile with enough pairs."""
    q = prominences(profile.where(F.col("pairs") >= least_pairs), keys, "lag_bin_center", "dcf")
    best = band_maximum(q, keys, "lag_bin_center", "dcf", bands, others=["pairs", "is_local_peak", "prominence", "lag_bin_start", "lag_bin_end"])
    half = (F.col("lag_bin_end") - F.col("lag_bin_start") + 1) / 2
    return _edges(best, keys, bands, "lag_bin_center", half, half, ["dcf", "pairs"])


def spectrum_morphology(spectrum: DataFrame, keys: Sequence[str], bands: dict[str, tuple[int, int]]) -> DataFrame:
    """Band maximum of a spectrum with at_band_edge (outer 2 % of the band), is_local_peak and prominence over the whole spectrum."""
    q = prominences(spectrum, keys, "period_days", "power")
    best = band_maximum(q, keys, "period_days", "power", bands, others=["is_local_peak", "prominence"])
    return _edges(best, keys, bands, "period_days", None, None, ["power"])


def _edges(best: DataFrame, keys: Sequence[str], bands: dict[str, tuple[int, int]], x: str, low: Column | None, high: Column | None, others: Sequence[str]) -> DataFrame:
    edge = F.lit(None).cast("boolean")
    for b, (lo, hi) in bands.items():
        margin = F.lit(0.02 * (hi - lo))
        edge = F.when(F.col("band") == b, (F.col(x) <= lo + (margin if low is None else low)) | (F.col(x) >= hi - (margin if high is None else high))).otherwise(edge)
    return best.select(*keys, "band", x, *others, edge.alias("at_band_edge"), "is_local_peak", "prominence")


def nearest_window_peak(signals: DataFrame, window_peaks: DataFrame, keys: Sequence[str], span: str = "span_days") -> DataFrame:
    """signals (keys, period_days, span) with the window peak of the nearest frequency, of the few that a key has, and its separation in resolution units."""
    listed = window_peaks.groupBy(*keys).agg(F.collect_list(F.struct("period_days", "power", "prominence")).alias("_p"))
    gaps = F.transform("_p", lambda p: F.struct(F.abs(1 / p["period_days"] - 1 / F.col("period_days")).alias("g"), p["period_days"].alias("w"), p["power"].alias("wp"), p["prominence"].alias("wq")))
    best = signals.join(listed, list(keys), "left").withColumn("b", F.array_min(gaps))
    separation = F.abs(1 / F.col("b.w") - 1 / F.col("period_days")) * F.col(span)
    return best.select(
        *signals.columns, F.col("b.w").alias("nearest_window_period_days"), F.col("b.wp").alias("nearest_window_power"), F.col("b.wq").alias("nearest_window_prominence"),
        F.abs(F.col("period_days") - F.col("b.w")).alias("absolute_period_difference_days"), separation.alias("frequency_separation_rayleigh"), (separation <= 1).alias("within_one_rayleigh"),
    )


def benchmark_verdicts(points: DataFrame, expected: Sequence[tuple[int, float]], lag_tolerance: int = 0, coefficient_tolerance: float = 0.015) -> DataFrame:
    """Expected (lag, coefficient) held against points (lag_days, coefficient): the nearest lag within tolerance and whether it agrees."""
    spark = points.sparkSession
    want = spark.createDataFrame([(int(a), float(b)) for a, b in expected], "expected_lag_days long, expected_coefficient double")
    lags = F.explode(F.sequence(F.col("expected_lag_days") - lag_tolerance, F.col("expected_lag_days") + lag_tolerance)).alias("lag_days")
    near = want.select("*", lags).join(points.select("lag_days", "coefficient"), "lag_days", "left")
    off = F.struct(F.col("coefficient").isNull().alias("no"), F.abs(F.col("coefficient") - F.col("expected_coefficient")).alias("c"), F.col("lag_days").alias("l"))
    best = near.groupBy("expected_lag_days", "expected_coefficient").agg(F.min_by(F.struct("lag_days", "coefficient"), off).alias("o"))
    ok = F.abs(F.col("o.coefficient") - F.col("expected_coefficient")) <= coefficient_tolerance
    return best.select("expected_lag_days", "expected_coefficient", F.when(F.col("o.coefficient").isNotNull(), F.col("o.lag_days")).alias("observed_lag_days"), F.col("o.coefficient").alias("observed_coefficient"), F.coalesce(ok, F.lit(False)).alias("replicated"))
