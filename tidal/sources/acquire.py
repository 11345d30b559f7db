"""Acquisition of a series' daily records and their assembly into records of 17 fields.

The archive's text comes first; the data service stands in where that can't be read.
Channels are kept as soon as they are there.  Full records are written only if
coordinates and speed are there as well; nothing is made up for a missing field.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import quality
from . import mapping, sinks, text
from .catalogue import CHANNELS, COORDINATES, RECORD, SPEED
from .service import Service, ServiceError

EXTRA = (*COORDINATES, SPEED)


class AcquisitionError(RuntimeError):
    """No permitted source gave records; the message holds each one's fault."""


@dataclass(frozen=True)
class Source:
    """Where the records of a series are: a path of archive text that Spark reads, and a data set of a service with its period."""

    name: str
    archive: str | None = None
    dataset: str | None = None
    start: str = ""
    stop: str = ""


def utc_date(time: Column) -> Column:
    """Date of an ISO time in UTC, by month and day or by day of year, whatever the session's time zone."""
    return F.coalesce(F.try_to_date(F.substring(time, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring(time, 1, 8), "yyyy-DDD"))


def mapped_daily(raw: DataFrame, fields: Sequence[mapping.Field]) -> tuple[DataFrame, dict]:
    """(date, the channels, coordinates and speed that a field stands for) as daily means, and the mapping."""
    time = mapping.time_column(raw.columns, fields)
    others = [c for c in raw.columns if c != time]
    found = mapping.channels(others, fields)
    found |= mapping.coordinates([c for c in others if c not in found.values()], fields)
    if lacking := [c for c in CHANNELS if c not in found]:
        raise ValueError(f"no field for {lacking}")
    try:
        found[SPEED] = mapping.bulk_speed(others, fields)
    except mapping.AmbiguousField:
        raise
    except ValueError:  # the speed may come from elsewhere
        pass
    rows = raw.select(utc_date(F.col(time)).alias("date"), *(F.col(f"`{c}`").try_cast("double").alias(target) for target, c in found.items()))
    return quality.daily_means(rows.where("date IS NOT NULL"), list(found)), {"time": time, "mapping": found}


def hourly_speed(raw: DataFrame, fields: Sequence[mapping.Field]) -> tuple[DataFrame, dict]:
    """(date, speed): mean of the positive speeds of a day, and the fields it is from."""
    time, speed = mapping.time_column(raw.columns, fields), mapping.bulk_speed(raw.columns, fields)
    rows = raw.select(utc_date(F.col(time)).alias("at"), F.col(f"`{speed}`").try_cast("double").alias("v")).where("at IS NOT NULL")
    return quality.positive_daily_mean(rows, "at", "v").select("date", F.col("value").alias(SPEED)), {"time": time, "speed": speed}


def acquire(spark: SparkSession, source: Source, service: Service | None = None, folder: str = "", ways: Sequence[str] = ("archive", "service")) -> tuple[DataFrame, dict]:
    """Daily records by the first of the ways that gives them, and notes on where they are from; folder takes what the service sends."""
    faults = []
    for way in ways:
        try:
            if way == "archive" and source.archive:
                rows, notes = text.daily_records(text.read_lines(spark, source.archive))
                return rows, {"transport": way, "path": source.archive, "parser": notes, "faults": faults}
            if way == "service" and service and source.dataset:
                info = service.info(source.dataset)
                rows, notes = mapped_daily(service.read_years(spark, info, source.start, source.stop, f"{folder}/{source.name}_raw"), info.parameters)
                return rows, {"transport": way, "dataset": source.dataset, **notes, "faults": faults}
            faults.append(f"{way}: not given")
        except (ServiceError, ValueError, PySparkException) as e:
            faults.append(f"{way}: {type(e).__name__}: {' '.join(str(e).split())[:500]}")
    raise AcquisitionError(f"{source.name}: " + " | ".join(faults))


def full_records(rows: DataFrame, speed: DataFrame | None = None) -> DataFrame | None:
    """(date, the 17 fields of a record), None if a field is missing; speed (date, speed) joins where rows have none."""
    if SPEED not in rows.columns and speed is not None:
        rows = rows.join(speed.select("date", SPEED), "date", "left")
    if text.columns_present(rows, [*CHANNELS, *EXTRA])[1]:
        return None
    return rows.withColumn("time_decimal_year", dates.to_decimal_year(F.col("date"))).select("date", *RECORD)


def report(rows: DataFrame, name: str, reference_rows: int) -> DataFrame:
    """(series, field, rows, finite, missing, zeros, dates, span and completeness) of every value field."""
    fields = [c for c in rows.columns if c not in ("date", "time_decimal_year")]
    return quality.series_report(rows.unpivot(["date"], fields, "field", "value"), ["field"], reference_rows).select(F.lit(name).alias("series"), "*")


def assemble(spark: SparkSession, source: Source, folder: str, service: Service | None = None, speed: DataFrame | None = None, ways: Sequence[str] = ("archive", "service"), reference_rows: int = 7042) -> dict[str, str]:
    """Acquires a series and writes its tables under folder; the paths by kind.

    daily: CSV of the records as acquired; records and fixed: CSV and fixed text of full records, if there are any;
    report: JSON of the report's rows; notes: JSON of where the records are from; digests: JSON of the files' SHA-256.
    """
    rows, notes = acquire(spark, source, service, folder, ways)
    paths = {"daily": f"{folder}/{source.name}_daily"}
    sinks.write_csv(rows.withColumn("date", F.col("date").cast("string")), paths["daily"])
    daily = spark.read.csv(paths["daily"], header=True, schema=", ".join(f"`{c}` {'date' if c == 'date' else 'double'}" for c in rows.columns))
    full = full_records(daily, speed)
    if full is not None:
        paths |= {"records": f"{folder}/{source.name}_records", "fixed": f"{folder}/{source.name}_fixed"}
        sinks.write_csv(full, paths["records"])
        sinks.write_fixed(full, paths["fixed"])
    written = [sinks.digests(spark, f"{p}/part-*").select(F.lit(kind).alias("kind"), "path", "sha256") for kind, p in paths.items()]
    for kind, document in (
        ("report", report(daily if full is None else full, source.name, reference_rows)),
        ("notes", spark.createDataFrame([(source.name, json.dumps(notes, default=str))], "series string, notes string")),
        ("digests", written[0] if len(written) == 1 else written[0].unionByName(written[1]).unionByName(written[2])),
    ):
        paths[kind] = f"{folder}/{source.name}_{kind}"
        document.write.mode("overwrite").json(paths[kind])
    return paths
