"""Daily series built from the star-schema tables, and the constants of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Series A and B, the two bands in days, and the affected channels with the cutoff of the quality mask.
A, B = "1-URGENT", "2-HIGH"
BANDS = {"annual": (330, 400), "long": (430, 520)}
AFFECTED, CUTOFF = ("1-URGENT", "3-MEDIUM"), "1998-08-26"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, date, value): order totals by priority, over all orders."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("channel"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return rows.groupBy("channel", "date").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Series A and B of orders: (date, value)."""
    rows = orders(spark, sf_dir)
    return tuple(rows.where(F.col("channel") == c).select("date", "value") for c in (A, B))  # type: ignore[return-value]


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, date, value): line revenue by return flag and ship date."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("channel"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return rows.groupBy("channel", "date").agg(F.round(F.sum("v"), 4).alias("value"))


def geometry(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """(date, x, y, z, speed): coordinates and a speed with unknown days, for one of two sides (0 or 1)."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.avg("l_quantity") / (10 if side == 0 else 20), 6).alias("x"), F.round(F.avg("l_tax") * 10, 6).alias("y"),
        F.round(F.avg("l_discount") * 10, 6).alias("z"), F.round(300 + F.avg("l_extendedprice") / 1000, 3).alias("s"),
    )
    known = F.datediff("date", F.lit("1995-01-01")) % (11 if side == 0 else 13) != 0
    return rows.select("date", "x", "y", "z", F.when(known, F.col("s")).alias("speed"))


#: The same in DuckDB SQL.
SQL = {
    "O": "O AS (SELECT o_orderpriority AS channel, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)",
    "A": f"A AS (SELECT date, value FROM O WHERE channel = '{A}')",
    "B": f"B AS (SELECT date, value FROM O WHERE channel = '{B}')",
    "R": "R AS (SELECT l_returnflag AS channel, CAST(l_shipdate AS DATE) AS date, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem GROUP BY 1, 2)",
    "G0": "G0 AS (SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_quantity) / 10, 6) AS x, round(avg(l_tax) * 10, 6) AS y, round(avg(l_discount) * 10, 6) AS z, CASE WHEN date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 11 <> 0 THEN round(300 + avg(l_extendedprice) / 1000, 3) END AS speed FROM lineitem GROUP BY 1, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)))",
    "G1": "G1 AS (SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_quantity) / 20, 6) AS x, round(avg(l_tax) * 10, 6) AS y, round(avg(l_discount) * 10, 6) AS z, CASE WHEN date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 13 <> 0 THEN round(300 + avg(l_extendedprice) / 1000, 3) END AS speed FROM lineitem GROUP BY 1, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)))",
}


def with_(*names: str) -> str:
    """WITH clause of the named inputs."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] if n in SQL else n for n in names) + " "
