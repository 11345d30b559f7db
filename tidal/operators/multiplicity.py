"""Family-wise and false-discovery adjustment of p-values, and summaries of Monte-Carlo nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjusted(rows: DataFrame, family: Sequence[str], p: str = "p", order: Sequence[str] = ()) -> DataFrame:
    """rows with p_holm and q_bh over each family; null p-values don't count and stay null."""
    value = F.when(~F.isnan(p), F.col(p))
    known = rows.withColumn("_p", value)
    of = Window.partitionBy(*family, F.col("_p").isNull())
    up = of.orderBy("_p", *order)
    ranked = known.withColumn("_m", F.count("_p").over(of)).withColumn("_r", F.row_number().over(up))
    holm = F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col("_p"))).over(of.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.least(F.lit(1.0), F.col("_m") * F.col("_p") / F.col("_r"))).over(of.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_holm", F.when(F.col("_p").isNotNull(), holm)).withColumn("q_bh", F.when(F.col("_p").isNotNull(), bh)).drop("_p", "_m", "_r")


def null_summary(null: DataFrame, observed: DataFrame, keys: Sequence[str], statistic: str = "statistic", none_used: float | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Per key: observed, p_value ((exceedances + 1) / (used + 1)), exceedances, used, null_q95, null_q99 of simulated statistics; null ones are not used, and without any the p-value is none_used.  also: further columns of observed."""
    joined = observed.select(*keys, F.col(statistic).alias("observed"), *also).join(null.select(*keys, F.col(statistic).alias("v")), list(keys), "left")
    got = joined.groupBy(*keys, "observed", *also).agg(
        F.count_if(F.col("v") >= F.col("observed")).alias("exceedances"), F.count("v").alias("used"),
        F.percentile("v", F.lit(0.95)).alias("null_q95"), F.percentile("v", F.lit(0.99)).alias("null_q99"),
    )
    p = F.when(F.col("used") > 0, (F.col("exceedances") + 1) / (F.col("used") + 1)).otherwise(F.lit(none_used).cast("double"))
    return got.select(*keys, "observed", *also, p.alias("p_value"), "exceedances", "used", "null_q95", "null_q99")


def at_floor(p: Column, simulations: int) -> Column:
    """Whether p is the least that so many simulations can give."""
    return F.abs(p - 1 / (simulations + 1)) < 1e-12
