"""Queries of the sources and sinks: records made from the tables are written, read back and parsed."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..sources import acquire, formats, sinks, text
from ..sources.catalogue import ALIASES, CHANNELS, COORDINATES, RECORD, SPEED
from ..sources.store import shared_folder
from . import inputs, spectral_queries, stand_in
from .inputs import with_
from .registry import ORACLES, query, tidy

FIELDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: A record's values as aggregates over the lines of a day; two of them are unknown on some days.
_CELLS = dict(zip(RECORD[1:], [
    *(f"{f}({c})" for c in FIELDS for f in ("min", "max")), "count(*)", *(f"count(CASE WHEN l_returnflag = '{x}' THEN 1 END)" for x in "RAN"),
    "max(l_linenumber)", "min(l_linenumber)", "CASE WHEN count(*) % 2 = 0 THEN max(l_suppkey) END", "CASE WHEN count(*) % 3 > 0 THEN max(l_partkey) END",
]))
#: The last days of a year are one record, as a decimal year of day / 365 can't tell them from the next year's first.
_DAY = ("CAST(year(l_shipdate) AS INT)", "CAST(least(dayofyear(l_shipdate), 364) AS INT)")
_DATE = "make_date(y, 1, 1) + (d - 1)"
_TIME = "round(y + d / CAST(365 AS DOUBLE), 6)"
_K = f"WITH K AS (SELECT {_DAY[0]} AS y, {_DAY[1]} AS d, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in _CELLS.items())} FROM lineitem GROUP BY 1, 2), D AS (SELECT {_DATE} AS date, {_TIME} AS time_decimal_year, * FROM K)"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, d, date and the columns of a record): one record a day, over all lines."""
    rows = inputs.table(spark, sf_dir, "lineitem").groupBy(F.expr(_DAY[0]).alias("y"), F.expr(_DAY[1]).alias("d"))
    return rows.agg(*(F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in _CELLS.items())).select("y", "d", F.expr("date_add(make_date(y, 1, 1), d - 1)").alias("date"), F.expr(_TIME).alias("time_decimal_year"), *_CELLS)


@query(_K + f" SELECT date, time_decimal_year, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _CELLS)} FROM D")
def fixed_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_fixed(_records(spark, sf_dir), path)
    return tidy(text.fixed_records(text.read_lines(spark, path)).select("date", *RECORD))


def _archive_csv(spark: SparkSession, sf_dir: str) -> str:
    """A folder of CSV files with the archive's field names."""
    path, names = _folder(spark), {c: a for a, c in reversed(ALIASES.items())}
    sinks.write_csv(_records(spark, sf_dir).select("time_decimal_year", *(F.col(c).alias(names[c]) for c in _CELLS)), path)
    return path


@query(_K + f" SELECT date, time_decimal_year, {', '.join(_CELLS)} FROM D")
def csv_alias_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.read_auto(spark, _archive_csv(spark, sf_dir), "records.csv")
    return tidy(rows.select("date", *(F.col(c).cast("double").alias(c) for c in RECORD)))


@query(_K + " SELECT kind, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(CASE WHEN kind = 'fixed' THEN 0 ELSE solar_wind_speed_km_s END) AS speeds FROM D, (VALUES ('fixed'), ('csv')) v(kind) GROUP BY 1")
def auto_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = _folder(spark)
    sinks.write_fixed(_records(spark, sf_dir), fixed)
    found = [text.read_auto(spark, p).select(F.lit(kind).alias("kind"), "date", F.col(SPEED).cast("double").alias("speed")) for kind, p in (("fixed", fixed), ("csv", _archive_csv(spark, sf_dir)))]
    return found[0].unionByName(found[1]).groupBy("kind").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("speed").alias("speeds"))


_WIDTH = "CASE WHEN e_7_17_mev % 5 = 0 THEN 5 ELSE 4 END"


@query(_K + f", N AS (SELECT {_WIDTH} AS width, y, d, e_7_17_mev AS n, minimum_ionizing_x2 AS m FROM D WHERE e_7_17_mev % 7 <> 0), M AS (SELECT width FROM N GROUP BY 1 ORDER BY count(*) DESC LIMIT 1) SELECT CAST(width AS BIGINT) AS width, CAST(y AS DOUBLE) AS v0, CAST(d AS DOUBLE) AS v1, n AS v2, m * 10 AS v3 FROM N JOIN M USING (width)")
def numeric_record_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two widths with mixed separators and D exponents, some of them with text."""
    path, n = _folder(spark), F.col("e_7_17_mev")
    number = F.when(n % 7 == 0, "n/a").otherwise(F.concat(F.col("minimum_ionizing_x2").cast("int").cast("string"), F.lit(".0D+01")))
    line = F.concat(F.col("y"), F.lit(" "), F.col("d"), F.lit(", "), n.cast("int"), F.lit(","), number, F.when(n % 5 == 0, " 0").otherwise(""))
    _records(spark, sf_dir).select(line.alias("value")).write.text(path)
    rows, _ = text.numeric_records(text.read_lines(spark, path))
    return tidy(rows.select(F.size("values").alias("width"), *(F.get("values", F.lit(i)).alias(f"v{i}") for i in range(4))))


#: Layouts with the fields before the values and the number of value columns.
_LAYOUTS = {
    "year_doy": (("y", "d"), 16), "year_doy_hour_particles": (("y", "d", "12"), 12), "scid_year_doy": (("2", "y", "d"), 15), "decimal_year": (("time_decimal_year",), 12),
}


def _layout_sql(name: str, values: int) -> str:
    cells = [f"coalesce({c}, 0)" if i < values else "NULL" for i, c in enumerate(_CELLS)]
    return f"SELECT '{name}' AS layout, date, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in zip(_CELLS, cells))} FROM D"


@query(_K + " " + " UNION ALL ".join(_layout_sql(n, v) for n, (_, v) in _LAYOUTS.items()))
def daily_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records in every layout, each recognised from its numbers."""
    out, records = [], _records(spark, sf_dir)
    for head, values in _LAYOUTS.values():
        path = _folder(spark)
        cells = [F.coalesce(c, F.lit(0.0)) for c in list(_CELLS)[:values]]
        records.select(F.concat_ws(" ", *(F.expr(f"CAST({h} AS STRING)") for h in head), *(c.cast("string") for c in cells)).alias("value")).write.text(path)
        rows, info = text.daily_records(text.read_lines(spark, path))
        out.append(rows.withColumn("layout", F.lit(info["layout"])))
    return tidy(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), out).select("layout", "date", *CHANNELS, *COORDINATES, SPEED))


@query(_K + f" SELECT date, round(y % 100 + d / CAST(365 AS DOUBLE), 6) AS time_decimal_year, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _CELLS)} FROM D")
def assembled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive's text acquired, assembled into full records and read back."""
    path, cells = _folder(spark), [F.coalesce(c, F.lit(0.0)).cast("string") for c in _CELLS]
    _records(spark, sf_dir).select(F.concat_ws(" ", "y", "d", *cells).alias("value")).write.text(path)
    paths = acquire.assemble(spark, acquire.Source("lines", archive=path), _folder(spark))
    rows = text.read_csv(spark, paths["records"]).select("date", *(F.col(c).cast("double").alias(c) for c in RECORD))
    return tidy(rows.withColumn("time_decimal_year", F.round("time_decimal_year", 6)))


@query("SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS status, c_name AS lidvid, CAST(CASE WHEN c_mktsegment <> 'BUILDING' THEN 3 ELSE 1 END AS BIGINT) AS fields FROM customer")
def collection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    line = F.when(F.col("c_mktsegment") != "BUILDING", F.concat_ws(",", F.concat("c_mktsegment", F.lit(" ")), F.concat(F.lit(" "), "c_name"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    inputs.table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return tidy(text.collection_manifest(text.read_lines(spark, path)).select("status", "lidvid", F.size("raw").alias("fields")))


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10)) AS sha256 FROM nation GROUP BY 1")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of names for each region."""
    path = _folder(spark)
    rows = inputs.table(spark, sf_dir, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_nationkey")
    rows.select(F.col("n_name").alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(path)
    return sinks.digests(spark, f"{path}/*").select(F.regexp_extract("path", r"n_regionkey=([0-9]+)", 1).cast("long").alias("region"), "sha256")


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, c_mktsegment FROM customer")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    rows = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), F.expr("CASE WHEN c_acctbal > 0 THEN c_acctbal END").alias("balance"), "c_mktsegment")
    sinks.as_documents(rows, []).select("document").write.text(path)
    return text.read_documents(spark, path, rows.schema)


@query(_K + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS rows, count({c}) AS finite, count(*) - count({c}) AS missing, count(CASE WHEN {c} = 0 THEN 1 END) AS zeros, min(date) AS first_date, max(date) AS last_date, date_diff('day', min(date), max(date)) + 1 AS span_days, count(*) = 7042 AS matches_reference, count({c}) = date_diff('day', min(date), max(date)) + 1 AS complete FROM D" for c in _CELLS))
def record_field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _records(spark, sf_dir).unpivot(["date"], list(_CELLS), "field", "value")
    return quality.series_report(long, ["field"], 7042)


@query(_K + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS values_a, count(CASE WHEN y < 1998 THEN {c} END) AS values_b FROM D" for c in CHANNELS[1:-1]))
def shared_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the channels that two frames, each without one of the channels, have in common."""
    records = _records(spark, sf_dir)
    frames = records.drop(CHANNELS[0]), records.where("y < 1998").drop(CHANNELS[-1])
    both = text.columns_present(frames[1], text.columns_present(frames[0], CHANNELS)[0])[0]
    a, b = (f.unpivot([], both, "field", "value").groupBy("field").agg(F.count("value").alias(n)) for f, n in zip(frames, ("values_a", "values_b")))
    return a.join(b, "field")


@query(with_("G0", "G1") + "SELECT side, count(x) > 0 AND count(y) > 0 AND count(z) > 0 AND count(speed) > 0 AS usable FROM (SELECT CAST(0 AS BIGINT) AS side, * FROM G0 UNION ALL SELECT 1, * FROM G1 UNION ALL SELECT 2, date, x, y, z, NULL FROM G0) GROUP BY 1")
def geometry_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [inputs.geometry(spark, sf_dir, 0), inputs.geometry(spark, sf_dir, 1), inputs.geometry(spark, sf_dir, 0).drop("speed")]
    found = [s.agg(quality.has_geometry(s, ["x", "y", "z", "speed"]).alias("usable")).select(F.lit(i).cast("long").alias("side"), "usable") for i, s in enumerate(sides)]
    return reduce(DataFrame.unionByName, found)


@query(f"SELECT band, count(*) AS windows, count(CASE WHEN both_peaks AND within_10_percent THEN 1 END) AS concordant FROM ({ORACLES['period_concordance']}) GROUP BY 1")
def concordant_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectral_queries.period_concordance(spark, sf_dir)
    return rows.groupBy("band").agg(F.count("*").alias("windows"), F.count_if(F.col("both_peaks") & F.col("within_10_percent")).alias("concordant"))


@query(_K + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS rows, count({c}) AS present, count({c}) AS finite, count(*) - count({c}) AS missing, count(CASE WHEN {c} = 0 THEN 1 END) AS zeros, round(sum({c}), 4) AS total FROM D" for c in _CELLS))
def committed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field report of a committed folder, beside sums of what is read back from it."""
    formats.register(spark)
    path = _folder(spark)
    _records(spark, sf_dir).select("date", *_CELLS).write.format("measurement_records").mode("overwrite").save(path)
    back = spark.read.format("measurement_records").option("path", path).load()
    sums = back.unpivot([], list(_CELLS), "field", "value").groupBy("field").agg(F.round(F.sum("value"), 4).alias("total"))
    return formats.field_report(spark, path).join(sums, "field")


def _serve_records(spark: SparkSession, sf_dir: str) -> str:
    """URL of a service that sends the daily records, one file a year."""
    path = _folder(spark)
    time = F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z"))
    line = F.concat_ws(",", time, *(F.coalesce(F.col(c).cast("string"), F.lit("-9999")) for c in _CELLS))
    _records(spark, sf_dir).select("y", line.alias("value")).repartition("y").write.partitionBy("y").text(path)

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def lines(start: str, stop: str) -> list[str]:
        # read without a job, as the tasks that ask may hold all cores; a year of days at most
        folder, out = jvm.org.apache.hadoop.fs.Path(f"{path}/y={start[:4]}"), []
        system = folder.getFileSystem(conf)
        for file in system.listStatus(folder) if system.exists(folder) else ():
            stream = system.open(file.getPath())
            out += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
        return [x for x in out if start <= x[:10] < stop]

    fields = [{"name": "Time", "type": "isotime"}, *({"name": c, "type": "double", "fill": "-9999"} for c in _CELLS)]
    span = spark.read.text(path).select(F.min(F.substring("value", 1, 10)), F.max(F.substring("value", 1, 10))).first()
    return stand_in.serve(spark.conf.get("spark.driver.host", "127.0.0.1"), {"startDate": span[0], "stopDate": span[1], "parameters": fields}, lines)


_CUT = ("1996-03-15", "1999-06-30")


@query(_K + f" SELECT date, {', '.join(_CELLS)} FROM D WHERE date BETWEEN DATE '{_CUT[0]}' AND DATE '{_CUT[1]}'")
def service_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period of a service's data set, a task a year; the bounds reach the service."""
    formats.register(spark)
    rows = spark.read.format("measurement_service").options(url=_serve_records(spark, sf_dir), dataset="records").load()
    cut = rows.where((F.col("Time") >= F.lit(f"{_CUT[0]} 00:00:00").cast("timestamp")) & (F.col("Time") <= F.lit(f"{_CUT[1]} 00:00:00").cast("timestamp")))
    return tidy(cut.select(F.col("Time").cast("date").alias("date"), *_CELLS))


_NAMED = dict(zip((*CHANNELS, *COORDINATES, SPEED), _CELLS))


@query(_K + f" SELECT date, {', '.join(f'{c} AS {n}' for n, c in _NAMED.items())} FROM D")
def service_daily_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service's fields mapped to channels, coordinates and speed by their metadata, as daily means."""
    formats.register(spark)
    rows = spark.read.format("measurement_service").options(url=_serve_records(spark, sf_dir), dataset="records").load()
    fields = [{"name": f, "type": "isotime" if k == "timestamp" else "double"} for f, k in rows.dtypes]
    daily, _ = acquire.mapped_daily(rows.withColumn("Time", F.date_format("Time", "yyyy-MM-dd")), fields)
    return tidy(daily.select("date", *_NAMED))
