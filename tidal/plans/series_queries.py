"""Queries of the series model, quality reports, alignment and propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, scalars
from ..operators import lagcorr, peaks, quality, series
from . import inputs
from .inputs import with_
from .registry import query, tidy

FIELDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 6) AS o_totalprice, round(avg(o_custkey), 6) AS o_custkey FROM orders GROUP BY 1")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_custkey")
    return quality.daily_means(rows, ["o_totalprice", "o_custkey"]).select("date", F.round("o_totalprice", 6).alias("o_totalprice"), F.round("o_custkey", 6).alias("o_custkey"))


@query("SELECT CAST(ts AS DATE) AS date, round(avg(CASE WHEN value > 0 THEN value END), 7) AS value, count(CASE WHEN value > 0 THEN 1 END) AS n FROM events GROUP BY 1")
def hourly_to_daily_positive_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.positive_daily_mean(inputs.table(spark, sf_dir, "events"), "ts", "value"))


@query(with_("O") + f"SELECT channel, date, CASE WHEN channel IN {inputs.AFFECTED} AND date >= DATE '{inputs.CUTOFF}' THEN NULL ELSE value END AS value FROM O")
def quality_mask_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.quality_mask(inputs.orders(spark, sf_dir), F.col("channel").isin(*inputs.AFFECTED), inputs.CUTOFF)


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS rows, count(CASE WHEN isfinite({f}) THEN 1 END) AS finite, count(CASE WHEN {f} IS NULL OR isnan({f}) THEN 1 END) AS missing, count(CASE WHEN {f} = 0 THEN 1 END) AS zeros FROM lineitem" for f in FIELDS))
def data_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.field_summary(inputs.table(spark, sf_dir, "lineitem"), FIELDS)


@query(with_("O") + f", M AS (SELECT channel, date, CASE WHEN channel IN {inputs.AFFECTED} AND date >= DATE '{inputs.CUTOFF}' THEN NULL ELSE value END AS value FROM O) SELECT channel, count(*) AS rows, count(value) AS finite, count(*) - count(value) AS missing, count(CASE WHEN value = 0 THEN 1 END) AS zeros, min(date) AS first_date, max(date) AS last_date, date_diff('day', min(date), max(date)) + 1 AS span_days, count(*) = 7042 AS matches_reference, count(value) = date_diff('day', min(date), max(date)) + 1 AS complete FROM M GROUP BY 1")
def channel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.series_report(quality_mask_cutoff(spark, sf_dir), ["channel"], 7042)


@query(with_("O", "A", "B") + "SELECT date, A.value AS a, B.value AS b FROM A JOIN B USING (date)")
def aligned_common_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.aligned(*inputs.pair(spark, sf_dir))


@query(with_("O", "A", "G0") + "SELECT date, round(year(date) % 100 + dayofyear(date) / 365.0::DOUBLE, 7) AS time_decimal_year, A.value, x, y, z, speed, CAST(NULL AS DOUBLE) AS absent FROM A LEFT JOIN G0 USING (date)")
def left_assembly_decimal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = inputs.pair(spark, sf_dir)
    return tidy(series.assembled(a, inputs.geometry(spark, sf_dir, 0), ["value", "x", "y", "z", "speed", "absent"]))


_ROUND = ", E AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), V AS (SELECT date, (year(date) % 100 + dayofyear(date) / 365.0::DOUBLE) AS v FROM E), W AS (SELECT date, v, floor(v) AS yy, round_even((v - floor(v)) * 365.0, 0) AS o FROM V) SELECT date, round(v, 7) AS v, make_date(CAST(CASE WHEN yy >= 100 THEN yy ELSE yy + 1900 END AS INT), 1, 1) + CAST(greatest(least(o, 365), 1) - 1 AS INT) AS decoded_365, make_date(CAST(CASE WHEN yy BETWEEN 0 AND 99 THEN yy + 1900 ELSE yy END AS INT), 1, 1) + CAST(greatest(least(o, 366), 1) - 1 AS INT) AS decoded_366 FROM W"


@query(with_("O") + _ROUND)
def decimal_year_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = inputs.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().withColumn("v", dates.to_decimal_year(F.col("date")))
    return days.select("date", F.round("v", 7).alias("v"), dates.from_decimal_year(F.col("v")).alias("decoded_365"), dates.from_decimal_year(F.col("v"), 366).alias("decoded_366"))


_GRID = ", L AS (SELECT channel, min(date) AS lo, max(date) AS hi FROM O GROUP BY 1), D AS (SELECT channel, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM L)"


@query(with_("O") + _GRID + " SELECT D.channel, D.date, O.value FROM D LEFT JOIN O ON D.channel = O.channel AND D.date = O.date")
def dense_daily_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dense_grid(inputs.orders(spark, sf_dir), ["channel"])


@query(with_("O") + _GRID + " SELECT D.channel, count(*) AS days, count(O.value) AS observed FROM D LEFT JOIN O ON D.channel = O.channel AND D.date = O.date GROUP BY 1")
def observation_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dense_grid(inputs.orders(spark, sf_dir), ["channel"]).groupBy("channel").agg(F.count("*").alias("days"), F.count("value").alias("observed"))


_LOG = ", P AS (SELECT channel, date, date_diff('day', DATE '1970-01-01', date) AS t, log10(value) AS y FROM O WHERE value > 0), C AS (SELECT channel, date, t - avg(t) OVER w AS t, y - avg(y) OVER w AS y FROM P WINDOW w AS (PARTITION BY channel)), F AS (SELECT channel, date, y - coalesce(sum(y * t) OVER w / nullif(sum(t * t) OVER w, 0), 0) * t AS y FROM C WINDOW w AS (PARTITION BY channel))"
_CLIP = ("1996-01-01", "1999-12-31")


@query(with_("O") + _LOG + f", D AS (SELECT channel, CAST(unnest(generate_series(DATE '{_CLIP[0]}', DATE '{_CLIP[1]}', INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT channel FROM O)) SELECT D.channel, D.date, round(F.y, 7) + 0.0 AS value FROM D LEFT JOIN F ON D.channel = F.channel AND D.date = F.date")
def dense_log_grid_detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line is fitted to the whole record, then the grid is clipped."""
    rows = inputs.orders(spark, sf_dir)
    flat = series.detrended(series.with_day(series.transformed(rows, "log10")), ["channel"], "linear")
    limits = rows.select("channel").distinct().select("channel", *(F.lit(d).cast("date").alias(n) for n, d in zip(("first", "last"), _CLIP)))
    return tidy(series.dense_grid(flat, ["channel"], limits))


@query(with_("O", "A", "B") + ", J AS (SELECT date, date_diff('day', lag(date) OVER (ORDER BY date), date) AS step FROM A JOIN B USING (date)) SELECT count(*) AS common_rows, min(date) AS start_date, max(date) AS stop_date, date_diff('day', min(date), max(date)) AS calendar_span_days, count(CASE WHEN step = 1 THEN 1 END) AS one_day_steps, count(CASE WHEN step > 1 THEN 1 END) AS gaps_gt_1_day, coalesce(max(step), 0) AS max_gap_days, round(avg(step), 7) AS mean_step_days, round(quantile_cont(step, 0.5), 7) AS median_step_days FROM J")
def alignment_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.spacing(series.aligned(*inputs.pair(spark, sf_dir)).withColumn("k", F.lit(1)), ["k"]).drop("k"))


_LAGS = (0, 1, 30, 341, 100000)
_SEPARATION = ", Q AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM {src}), K AS (SELECT unnest([{lags}]) AS k), Z AS (SELECT k, date_diff('day', x.date, y.date) AS gap FROM K JOIN Q x ON k <> 0 JOIN Q y ON y.i = x.i + k) SELECT CAST(K.k AS BIGINT) AS sample_lag, count(gap) AS pairs, round(avg(gap), 7) AS mean_calendar_days, round(quantile_cont(gap, 0.5), 7) AS median_calendar_days, min(gap) AS min_calendar_days, max(gap) AS max_calendar_days FROM K LEFT JOIN Z ON K.k = Z.k GROUP BY 1"


@query(with_("O", "A", "B") + _SEPARATION.format(src="A JOIN B USING (date)", lags=", ".join(map(str, _LAGS))))
def sample_lag_separation_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.lag_separation(series.aligned(*inputs.pair(spark, sf_dir)), _LAGS))


@query(with_("O", "A") + _SEPARATION.format(src="A", lags=", ".join(map(str, _LAGS))))
def sample_lag_separation_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.lag_separation(inputs.pair(spark, sf_dir)[0], _LAGS))


_V = "CASE WHEN coalesce(A.speed, 0) <> 0 AND coalesce(B.speed, 0) <> 0 THEN (A.speed + B.speed) / 2 WHEN coalesce(A.speed, 0) <> 0 THEN A.speed WHEN coalesce(B.speed, 0) <> 0 THEN B.speed ELSE 400.0 END"
_DELAY = f", T AS (SELECT a0.date, a0.value AS a, b0.value AS b, sqrt(A.x * A.x + A.y * A.y + A.z * A.z) AS ra, sqrt(B.x * B.x + B.y * B.y + B.z * B.z) AS rb, {_V} AS v FROM A a0 JOIN B b0 USING (date) LEFT JOIN G0 A ON A.date = a0.date LEFT JOIN G1 B ON B.date = a0.date), U AS (SELECT date, a, b, ra, rb, v, CAST(round_even((ra - rb) / v * 1731.0, 0) AS BIGINT) AS delay_days, row_number() OVER (ORDER BY date) - 1 AS i FROM T)"
_SHIFT = _DELAY + ", S AS (SELECT U.date, U.i, U.a, U.b, U.delay_days, CASE WHEN Y.b IS NOT NULL AND U.a <> 0 THEN Y.b ELSE 0.0 END AS shifted, CASE WHEN Y.b IS NOT NULL AND U.a <> 0 THEN Y.i ELSE -1 END AS source FROM U LEFT JOIN U Y ON Y.i = U.i - U.delay_days)"


def _common(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = inputs.pair(spark, sf_dir)
    extra = ["x", "y", "z", "speed"]
    both = series.aligned(a.join(inputs.geometry(spark, sf_dir, 0), "date", "left"), b.join(inputs.geometry(spark, sf_dir, 1), "date", "left"), extra)
    radius = [scalars.radius(*(F.col(f"{c}_{s}") for c in "xyz")) for s in "ab"]
    speed = scalars.mean_speed(F.col("speed_a"), F.col("speed_b"))
    return both.select("date", "a", "b", radius[0].alias("ra"), radius[1].alias("rb"), speed.alias("v")).withColumn("delay_days", scalars.delay_days(F.col("ra"), F.col("rb"), F.col("v")))


@query(with_("O", "A", "B", "G0", "G1") + _DELAY + " SELECT date, round(ra, 7) AS r_a, round(rb, 7) AS r_b, round(v, 7) AS speed, delay_days FROM U")
def propagation_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_common(spark, sf_dir).select("date", F.col("ra").alias("r_a"), F.col("rb").alias("r_b"), F.col("v").alias("speed"), "delay_days"))


@query(with_("O", "A", "B", "G0", "G1") + _SHIFT + " SELECT date, a, b, delay_days, shifted, source FROM S")
def index_shifted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(lagcorr.index_shifted(_common(spark, sf_dir)))


def _xcorr_sql(src: str, x: str, y: str, lo: int, hi: int) -> str:
    return f", X AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, {x} AS x, {y} AS y FROM {src}), N AS (SELECT sqrt(sum(x * x) * sum(y * y)) AS n FROM X), K AS (SELECT unnest(generate_series({lo}, {hi})) AS k), CC AS (SELECT CAST(k AS BIGINT) AS lag_days, sum(p.x * q.y) / nullif((SELECT n FROM N), 0) AS coefficient FROM K JOIN X q ON true JOIN X p ON p.i = q.i + k GROUP BY 1)"


@query(with_("O", "A", "B", "G0", "G1") + _SHIFT + _xcorr_sql("S", "a", "shifted", -120, 120) + " SELECT lag_days, round(coefficient, 7) AS coefficient FROM CC")
def shifted_ccf(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = series.indexed(lagcorr.index_shifted(_common(spark, sf_dir)))
    return tidy(lagcorr.sample_correlation(moved.select("i", F.col("a").alias("value")), moved.select("i", F.col("shifted").alias("value")), [], -120, 120))


def _acf(spark: SparkSession, sf_dir: str, hi: int = 600) -> DataFrame:
    return lagcorr.sample_autocorrelation(inputs.pair(spark, sf_dir)[0], [], 0, hi)


def _ccf(spark: SparkSession, sf_dir: str, hi: int = 600) -> DataFrame:
    both = series.indexed(series.aligned(*inputs.pair(spark, sf_dir)))
    return lagcorr.sample_correlation(both.select("i", F.col("a").alias("value")), both.select("i", F.col("b").alias("value")), [], -hi, hi)


_ACF = with_("O", "A") + _xcorr_sql("A", "value", "value", 0, 600)
_CCF = with_("O", "A", "B") + _xcorr_sql("(SELECT date, A.value AS a, B.value AS b FROM A JOIN B USING (date))", "a", "b", -600, 600)


@query(_ACF + " SELECT lag_days, round(coefficient, 7) AS coefficient FROM CC")
def sample_acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(_acf(spark, sf_dir))


@query(_CCF + " SELECT -lag_days AS lag_days, round(coefficient, 7) AS coefficient FROM CC")
def sample_ccf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags in the recorded sign convention."""
    return tidy(_ccf(spark, sf_dir).withColumn("lag_days", scalars.historical_lag(F.col("lag_days"))))


def _bands_sql(x: str) -> str:
    return " UNION ALL ".join(f"SELECT '{b}' AS band, {lo} AS lo, {hi} AS hi" for b, (lo, hi) in inputs.BANDS.items())


@query(_CCF + f", BB AS ({_bands_sql('')}), Z AS (SELECT band, lag_days, coefficient, row_number() OVER (PARTITION BY band ORDER BY abs(coefficient) DESC, lag_days) AS r FROM CC JOIN BB ON lag_days BETWEEN lo AND hi WHERE coefficient IS NOT NULL) SELECT band, lag_days, round(coefficient, 7) AS coefficient FROM Z WHERE r = 1")
def ccf_band_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(peaks.band_maximum(_ccf(spark, sf_dir), [], "lag_days", "coefficient", inputs.BANDS, absolute=True))


_POINTS = (341, -214, 467, 5000)


@query(_CCF + f", P AS (SELECT unnest([{', '.join(map(str, _POINTS))}]) AS k) SELECT CAST(k AS BIGINT) AS lag_days, round(coefficient, 7) AS coefficient FROM P LEFT JOIN CC ON k = lag_days")
def ccf_point_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(peaks.at_points(_ccf(spark, sf_dir), [], "lag_days", _POINTS))


_EXPECTED = ((341, 0.2387), (-214, 0.080924), (0, 0.3), (5000, 0.5))


@query(_CCF + f", E AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b})' for a, b in _EXPECTED)}) v(l, c)) SELECT CAST(l AS BIGINT) AS expected_lag_days, CAST(c AS DOUBLE) AS expected_coefficient, lag_days AS observed_lag_days, round(coefficient, 7) AS observed_coefficient, coalesce(abs(coefficient - CAST(c AS DOUBLE)) <= 0.015, false) AS replicated FROM E LEFT JOIN CC ON lag_days = l")
def benchmark_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(peaks.benchmark_verdicts(_ccf(spark, sf_dir), _EXPECTED))


def runs_sql(src: str, x: str, y: str, keys: str = "") -> str:
    """CTEs that mark local maxima of src: PK with i, keys, x, y and peak."""
    by = f"PARTITION BY {keys} " if keys else ""
    k = f"{keys}, " if keys else ""
    kr = f"PARTITION BY {k}run"
    return (
        f", P0 AS (SELECT *, row_number() OVER ({by}ORDER BY {x}) AS i, lag({y}) OVER ({by}ORDER BY {x}) AS pv, lead({y}) OVER ({by}ORDER BY {x}) AS nx FROM {src} WHERE {y} IS NOT NULL AND NOT isnan({y})),"
        f" P1 AS (SELECT *, sum(CASE WHEN pv IS NULL OR pv <> {y} THEN 1 ELSE 0 END) OVER ({by}ORDER BY {x} ROWS UNBOUNDED PRECEDING) AS run FROM P0),"
        f" P2 AS (SELECT *, min(i) OVER ({kr}) AS i0, max(i) OVER ({kr}) AS i1, first(pv) OVER ({kr} ORDER BY i) AS lp, first(nx) OVER ({kr} ORDER BY i DESC) AS rn FROM P1),"
        f" PK AS (SELECT *, coalesce(lp < {y}, false) AND coalesce(rn < {y}, false) AND i = (i0 + i1) // 2 AS peak FROM P2)"
    )


@query(_CCF + ", Q AS (SELECT * FROM CC WHERE abs(lag_days) >= 1)" + runs_sql("Q", "lag_days", "coefficient") + ", Z AS (SELECT lag_days, coefficient, row_number() OVER (ORDER BY coefficient DESC, lag_days) AS rank FROM PK WHERE peak OR NOT (SELECT bool_or(peak) FROM PK)) SELECT lag_days, round(coefficient, 7) AS coefficient, rank FROM Z WHERE rank <= 12")
def acf_top_local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(peaks.correlation_peaks(_ccf(spark, sf_dir)))


@query(_ACF + ", Q AS (SELECT * FROM CC WHERE lag_days > 0 AND coefficient >= 0.1)" + runs_sql("Q", "lag_days", "coefficient") + ", Z AS (SELECT lag_days, coefficient FROM PK WHERE peak OR (SELECT count(*) FROM PK) < 3 ORDER BY coefficient DESC, lag_days LIMIT 20) SELECT lag_days, round(coefficient, 7) AS coefficient FROM Z")
def acf_positive_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(peaks.positive_lag_peaks(_acf(spark, sf_dir)))


_ENDS = ", ".join(f"{f}((SELECT {g}(date) FROM A), (SELECT {g}(date) FROM B)) AS {n}" for f, g, n in (("greatest", "min", "lo"), ("least", "max", "hi")))


@query(with_("O", "A", "B") + f", WE AS (SELECT {_ENDS}), Y AS (SELECT unnest([2, 3, 4, 5]) AS years), W AS (SELECT years, lo AS s FROM Y, WE UNION ALL SELECT years, CAST(s + INTERVAL 1 YEAR AS DATE) FROM W, WE WHERE s < hi), V AS (SELECT years, s AS window_start, CAST(s + to_years(years) - INTERVAL 1 DAY AS DATE) AS window_stop FROM W, WE WHERE s + to_years(years) - INTERVAL 1 DAY <= hi)"
       " SELECT CAST(years AS BIGINT) AS years, window_start, window_stop, (SELECT count(*) FROM A WHERE date BETWEEN window_start AND window_stop) AS values_a, (SELECT count(*) FROM B WHERE date BETWEEN window_start AND window_stop) AS values_b FROM V")
def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of whole years within the days that both series share, and the values of each in them."""
    a, b = (x.withColumn("side", F.lit(s)) for x, s in zip(inputs.pair(spark, sf_dir), "ab"))
    both = a.unionByName(b)
    span = series.common_span(both, ["side"]).first()
    found = [(y, *w) for y in (2, 3, 4, 5) for w in (series.calendar_windows(span["first"], span["last"], y) if span else [])]
    wins = spark.createDataFrame(found, "years long, window_start date, window_stop date")
    counts = [F.count(F.when(F.col("side") == s, F.col("value"))).alias(f"values_{s}") for s in "ab"]
    return series.in_windows(both, wins).groupBy("years", "window_start", "window_stop").agg(*counts)
