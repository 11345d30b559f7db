"""Writers of tables, documents and the fixed text layout, and file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue, downloads


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, mode="overwrite")


def as_documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): the other columns as JSON, one document a row."""
    return rows.select(*keys, F.to_json(F.struct(*(c for c in rows.columns if c not in keys)), {"ignoreNullFields": "false"}).alias("document"))


def fixed_lines(rows: DataFrame) -> DataFrame:
    """(value) lines of the 17-column layout: ten significant digits, 0 for nulls, in order of date within a partition."""
    number = lambda c: F.coalesce(F.regexp_replace(F.regexp_replace(F.format_string("%.10g", F.col(c)), r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1"), F.lit("0"))
    cells = [F.when(F.col(c).isNull(), F.lit("0")).otherwise(number(c)) for c in catalogue.RECORD]
    return rows.select(F.concat_ws(" ", *cells).alias("value"))


def write_fixed(rows: DataFrame, path: str) -> None:
    fixed_lines(rows).write.mode("overwrite").text(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return downloads.digests(spark, path).select("path", "sha256")
