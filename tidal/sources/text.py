"""Archival text and CSV records as DataFrames.

Parsers work on a DataFrame of lines (``value``), as spark.read.text gives it, so
large archives are read and parsed in parallel; only layout statistics (a few
numbers) come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import dates
from . import catalogue


class LayoutError(ValueError):
    """Records of no supported layout; the message holds diagnostics."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _tokens(value: Column, pattern: str) -> Column:
    return F.filter(F.split(F.trim(value), pattern), lambda t: t != "")


def fixed_records(lines: DataFrame) -> DataFrame:
    """Records of exactly 17 columns parted by white space, # comments left out, with their date."""
    bare = lines.select(F.regexp_replace("value", "#.*$", "").alias("value"))
    cells = bare.select(_tokens(F.regexp_replace("value", r"\s+", " "), " ").alias("c")).where(F.size("c") > 0)
    n = len(catalogue.RECORD)
    checked = cells.select(F.when(F.size("c") == n, F.col("c")).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} columns, found "), F.size("c").cast("string"))).cast("array<string>")).alias("c"))
    named = checked.select(*(F.get("c", F.lit(i)).try_cast("double").alias(name) for i, name in enumerate(catalogue.RECORD)))
    return named.withColumn("date", dates.from_decimal_year(F.col("time_decimal_year")))


def renamed(rows: DataFrame) -> DataFrame:
    """rows with archive field names replaced by the columns they stand for."""
    keys = {c: c.strip().upper().replace(" ", "_") for c in rows.columns}
    return rows.withColumnsRenamed({c: catalogue.ALIASES[k] for c, k in keys.items() if k in catalogue.ALIASES})


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and # comments; fields are renamed, values stay text until cast, and date is derived."""
    return dates.with_date(renamed(spark.read.csv(path, header=True, comment="#")))


def read_auto(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """CSV by its name; otherwise the fixed layout where the first records have it, else CSV."""
    if (name or path).lower().endswith(".csv"):
        return read_csv(spark, path)
    lines = read_lines(spark, path)
    cells = lines.select(_tokens(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s+", " "), " ").alias("c")).where(F.size("c") > 0)
    widths = cells.agg(F.min(F.size("c")), F.max(F.size("c")), F.count_if(F.exists("c", lambda t: t.try_cast("double").isNull()))).first()
    return fixed_records(lines) if widths[0] == widths[1] == len(catalogue.RECORD) and not widths[2] else read_csv(spark, path)


def numeric_records(lines: DataFrame, least: int = 10) -> tuple[DataFrame, dict]:
    """(values: array<double>) of the lines of the commonest width among numeric lines, and diagnostics.

    Values are parted by white space or commas and may have D exponents; lines with other text or fewer than 4
    values are left out.  Of equally common widths the one met first in file order counts.
    """
    cells = lines.withColumn("_at", F.monotonically_increasing_id()).select("_at", F.trim("value").alias("value"), _tokens(F.col("value"), r"[\s,]+").alias("t"))
    number = F.transform("t", lambda x: F.regexp_replace(F.upper(x), "D", "E").try_cast("double"))
    rows = cells.withColumn("values", number).where((F.size("values") >= 4) & F.forall("values", lambda v: v.isNotNull()))
    rows = rows.select("_at", "value", "values", F.size("values").alias("width"))
    widths = rows.groupBy("width").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy(F.desc("n"), "first").collect()
    if not widths:
        raise LayoutError("no numeric records")
    mode = widths[0]
    if mode["n"] < least:
        raise LayoutError(f"no stable record layout: width {mode['width']} in {mode['n']} records")
    diagnostics = {
        "numeric_records_total": sum(w["n"] for w in widths), "modal_width": mode["width"], "modal_records": mode["n"],
        "width_histogram": {str(w["width"]): w["n"] for w in sorted(widths, key=lambda w: w["width"])},
        "sample_numeric_lines": [r["value"] for r in rows.orderBy("_at").limit(5).collect()],
    }
    return rows.where(F.col("width") == mode["width"]).select("_at", "values"), diagnostics


def _share(condition: Column, value: Column) -> Column:
    """Share of the finite values that satisfy a condition."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.avg(F.when(ok, condition.cast("double")))


def _integral(v: Column) -> Column:
    return F.abs(v - F.rint(v)) < 1e-6


def daily_records(lines: DataFrame) -> tuple[DataFrame, dict]:
    """Daily channel records of a recognised layout: (date, channels, coordinates and speed if there), one row a date, and diagnostics.

    Layouts, the first that fits: year, day, hour and 12 channels; year, day and 12, 15 or 16 values; a constant
    number, year, day and values; a decimal year and values.  Any other fails.
    """
    rows, info = numeric_records(lines)
    width = info["modal_width"]
    v = lambda i: F.get("values", F.lit(i))
    year = lambda c: ((c >= 70) & (c <= 99)) | ((c >= 1970) & (c <= 2100))
    day = lambda c: (c >= 1) & (c <= 366) & _integral(c)
    facts = rows.agg(
        _share(year(v(0)), v(0)).alias("y0"), _share(day(v(1)), v(1)).alias("d1"), _share(year(v(1)), v(1)).alias("y1"), _share(day(v(2)), v(2)).alias("d2"),
        _share((v(2) >= 0) & (v(2) <= 23) & _integral(v(2)), v(2)).alias("h2"), F.stddev_pop(v(0)).alias("s0"), _share(((v(0) >= 70) & (v(0) < 100)) | ((v(0) >= 1970) & (v(0) < 2100)), v(0)).alias("dec"),
    ).first()
    over = lambda x: x is not None and x > 0.95
    if width >= 15 and over(facts["y0"]) and over(facts["d1"]):
        hours = width == 15 and over(facts["h2"])
        layout, start, date = ("year_doy_hour_particles", 3, dates.from_year_day(v(0), v(1))) if hours else ("year_doy", 2, dates.from_year_day(v(0), v(1)))
        if hours:
            info["hour_values"] = sorted(r[0] for r in rows.select(F.rint(v(2)).cast("int")).distinct().limit(24).collect())
    elif width >= 18 and facts["s0"] is not None and facts["s0"] < 1e-9 and over(facts["y1"]) and over(facts["d2"]):
        layout, start, date = "scid_year_doy", 3, dates.from_year_day(v(1), v(2))
    elif over(facts["dec"]):
        layout, start, date = "decimal_year", 1, dates.from_decimal_year(v(0), 366)
    else:
        raise LayoutError(f"no time field among {width} columns: {info}")
    values = width - start
    if values not in (12, 15, 16):
        raise LayoutError(f"layout {layout} leaves {values} values of {width} columns: {info}")
    names = [*catalogue.CHANNELS, *(catalogue.COORDINATES if values >= 15 else ()), *((catalogue.SPEED,) if values == 16 else ())]
    picked = rows.select("_at", date.alias("date"), *(v(start + i).alias(n) for i, n in enumerate(names)))
    first = picked.groupBy("date").agg(F.min_by(F.struct(*names), "_at").alias("r")).select("date", "r.*")
    info |= {"layout": layout, "value_columns_after_time": values, "contains_coordinates": values >= 15, "contains_solar_wind_speed": values == 16, "particle_channels": list(catalogue.CHANNELS)}
    span = first.agg(F.count("*"), F.min("date"), F.max("date")).first()
    info |= {"rows_after_date_deduplication": span[0], "start_date": str(span[1]), "stop_date": str(span[2])}
    return first, info


def collection_manifest(lines: DataFrame) -> DataFrame:
    """(status, lidvid, raw) of a headerless CSV: two fields or more give both, one gives lidvid only."""
    raw = lines.where(F.trim("value") != "").select(F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("raw"))
    two = F.size("raw") >= 2
    return raw.select(F.when(two, F.get("raw", F.lit(0))).alias("status"), F.when(two, F.get("raw", F.lit(1))).otherwise(F.get("raw", F.lit(0))).alias("lidvid"), "raw")


def year_chunks(start: str, stop: str) -> list[tuple[str, str]]:
    """(start, stop) of each calendar year's part of a period of ISO dates."""
    a, b = int(start[:4]), int(stop[:4])
    return [(start if y == a else f"{y}-01-01", stop if y == b else f"{y}-12-31") for y in range(a, b + 1)]


def read_documents(spark: SparkSession, path: str, schema: StructType | str, lines: bool = True) -> DataFrame:
    """JSON documents, one a line or (lines=False) one a file over several lines; a field that a document lacks is null."""
    return spark.read.json(path, schema=schema, multiLine=not lines, mode="FAILFAST")


def columns_present(rows: DataFrame, wanted: Sequence[str]) -> tuple[list[str], list[str]]:
    """The wanted columns that rows has, and those it lacks."""
    return [c for c in wanted if c in rows.columns], [c for c in wanted if c not in rows.columns]
