"""Reviews of tests: p-values by kind of test, adjusted over families, one row a candidate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import multiplicity

VARIANTS = ("raw", "detrended")
#: Autocorrelation of either side, and the correlation of both.
BRANCHES = ("acf_a", "acf_b", "ccf")
#: What a review tells of a test, and the columns that hold it.
FIELDS = ("lag", "observed", "p", "holm", "fdr")
COLUMNS = ("observed_at", "observed", "p", "p_holm", "q_bh")


def branch_p(shift: str = "p_shift", noise: str = "p_ar1") -> Column:
    """The p-value that counts in a branch: that of circular shifts for the correlation of both sides, else that of red noise."""
    return F.when(F.col("branch") == "ccf", F.col(shift)).otherwise(F.col(noise))


def adjusted_by_branch(tests: DataFrame, member: str = "channel") -> DataFrame:
    """Rows (member, band, variant, branch, observed, p) with p_holm and q_bh over the members of each band, variant and branch."""
    return multiplicity.adjusted(tests, ["band", "variant", "branch"], order=[member])


def by_branch(rows: DataFrame, keys: Sequence[str], simulations: int, members: int, level: float = 0.05, affected: Sequence[str] = ()) -> DataFrame:
    """One row per key from adjusted rows: where the statistic lies, observed, p, holm and fdr of every variant and branch, whether the channel is one of those affected by a quality mask, flags of the correlation of both sides, and the least
    p and Holm-adjusted p of members that so many simulations can give.  A test that is missing is null and flags nothing."""
    wide = rows.withColumn("of", F.concat_ws("_", "variant", "branch")).groupBy(*keys).pivot("of", [f"{v}_{b}" for v in VARIANTS for b in BRANCHES]).agg(
        *(F.first(c, ignorenulls=True).alias(n) for c, n in zip(COLUMNS, FIELDS))
    )
    no, floor = F.lit(False), 1 / (simulations + 1)
    significant = [F.coalesce(F.col(f"{v}_ccf_fdr") < level, no) for v in VARIANTS]
    out = {f"{v}_significant": s for v, s in zip(VARIANTS, significant)} | {"robust": reduce(Column.__and__, significant)}
    out |= {f"{v}_at_floor": F.coalesce(multiplicity.at_floor(F.col(f"{v}_ccf_p"), simulations), no) for v in VARIANTS}
    return wide.withColumns(out | {"p_floor": F.lit(floor), "holm_floor": F.lit(min(1.0, members * floor)), "quality_limited": F.col("channel").isin(*affected) if affected else no})


def candidates(reviewed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the rows given, each once."""
    return reviewed.select(*keys).dropDuplicates(list(keys))
