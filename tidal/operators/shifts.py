"""The correlation of one series with another at all rotations of it at once.

Over a record of n days, b rotated by s pairs with a at lag L where b was at lag
s + L before it left the record's end, and at s + L - n where it came in again.  So the
sums of every rotation and lag are two lagged sums of the plain series, less those
pairs of the second whose place lies before the record's start: the first L days of a.
These are running sums over the head of a, taken for blocks of s + L.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import kinds

BLOCK = 512


def every_lag(a: DataFrame, b: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(keys, n, lag, pairs, total): pairs and sums of products of a at i + lag and b at i, for all lags, of rows (keys, n, i, value) with i under n.

    Blocks of both series meet pairwise; each row goes to as many groups as the record has blocks.
    """
    of = F.floor(F.col("i") / block).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int")))
    by = [*keys, "n"]
    both = a.select(*by, of.alias("_a"), every.alias("_b"), F.lit(0).alias("_side"), "i", "value").unionByName(b.select(*by, every.alias("_a"), of.alias("_b"), F.lit(1).alias("_side"), "i", "value"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        p, q = int(key[-2]) * block, int(key[-1]) * block
        side, at, v = (part[c].to_numpy() for c in ("_side", "i", "value"))
        n = 1 << (2 * block - 1).bit_length()
        # b runs backwards, so that a product of transforms lays lag p - q + k - block + 1 at place k
        x = [np.bincount(at[side == 0] - p, w, block) for w in (np.ones((side == 0).sum()), v[side == 0])]
        y = [np.bincount(block - 1 - (at[side == 1] - q), w, block) for w in (np.ones((side == 1).sum()), v[side == 1])]
        sums = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(y, n), n)[:, : 2 * block - 1]
        pairs = np.rint(sums[0])
        some = pairs > 0
        return pd.DataFrame({**dict(zip(by, key)), "lag": (p - q - block + 1 + np.arange(2 * block - 1))[some], "pairs": pairs[some], "total": sums[1][some]})

    sums = both.groupBy(*by, "_a", "_b").applyInPandas(run, f"{kinds(a, by)}lag long, pairs double, total double")
    return sums.groupBy(*by, "lag").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))


def rotated_bins(a: DataFrame, b: DataFrame, keys: Sequence[str], lo: int, hi: int, width: int, margin: int, block: int = BLOCK) -> DataFrame:
    """(keys, shift, lag_bin_center, pairs, dcf) of a against b rotated by every shift from margin to n - margin, lags lo to hi pooled into bins of width days from lo.

    a and b are rows (keys, n, i, value), standardised, one a day i of a record of n days.
    Negative lags are those of both series read backwards, where a shift is n less it.
    """
    if max(-lo, hi) > margin:
        raise ValueError("lags must lie within the margin")
    parts = [_sums(a, b, keys, max(lo, 0), hi, 1, lo, width, margin, block)] if hi >= 0 else []
    if lo < 0:
        turn = lambda rows: rows.withColumn("i", F.col("n") - 1 - F.col("i"))
        parts.append(_sums(turn(a), turn(b), keys, max(1, -hi), -lo, -1, lo, width, margin, block))
    pooled = reduce(DataFrame.unionByName, parts).groupBy(*keys, "shift", "_b").agg(F.sum("pairs").cast("long").alias("pairs"), F.sum("_s").alias("_s"))
    centre = F.lit(lo) + F.col("_b") * width + (width - 1) / 2.0
    return pooled.select(*keys, "shift", centre.alias("lag_bin_center"), "pairs", F.when(F.col("pairs") > 0, F.try_divide(F.col("_s"), F.col("pairs"))).alias("dcf"))


def _sums(a: DataFrame, b: DataFrame, keys: Sequence[str], lo: int, hi: int, sign: int, origin: int, width: int, margin: int, block: int) -> DataFrame:
    """(keys, shift, _b, pairs, _s): sums per bin of lags sign * L, L from lo to hi, 0 or more; bins are counted from origin."""
    by, n, size = [*keys, "n"], F.col("n"), hi - lo + 1
    of = lambda c: F.floor(c / block).cast("long")
    # shift + lag is the place of a group's sums; j holds it for lags of b that came in again too
    lags = every_lag(a, b, keys)
    j = F.when(F.col("lag") < 0, F.col("lag") + n).otherwise(F.col("lag"))
    sums = lags.select(*by, of(j).alias("_j"), F.lit(0).alias("_kind"), j.alias("_at"), "pairs", "total")
    head = a.where(F.col("i") < hi).select(*by, F.explode(F.sequence(of(F.lit(margin + lo)), of(n - margin + hi))).alias("_j"), F.lit(1).alias("_kind"), F.col("i").alias("_at"), F.lit(1.0).alias("pairs"), F.col("value").alias("total"))
    back = b.select(*by, F.explode(F.sequence(of(n - F.col("i")), of(n - F.col("i") + (hi - 1)))).alias("_j"), F.lit(2).alias("_kind"), F.col("i").alias("_at"), F.lit(1.0).alias("pairs"), F.col("value").alias("total"))
    parts = sums.unionByName(head).unionByName(back).where((n >= 2 * margin + 1) & F.col("_j").between(of(F.lit(margin + lo)), of(n - margin + hi)))
    bin_of = (sign * np.arange(lo, hi + 1) - origin) // width
    low, bins = int(bin_of.min()), int(bin_of.max() - bin_of.min()) + 1

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        days, start = int(key[-2]), int(key[-1]) * block
        kind, at, both = part["_kind"].to_numpy(), part["_at"].to_numpy(), part[["pairs", "total"]].to_numpy().T
        places = start + np.arange(block)
        first = days - start - block + 1  # the day of b that the last place's first day of a meets
        shift = places[:, None] - np.arange(lo, hi + 1)
        valid = (shift >= margin) & (shift <= days - margin)
        slot = ((shift - (start - hi)) * bins + bin_of - low)[valid]
        out = []
        for w in both:
            whole = np.bincount(at[kind == 0] - start, w[kind == 0], block)
            x = np.bincount(at[kind == 1], w[kind == 1], hi)
            y = np.bincount(at[kind == 2] - first, w[kind == 2], block + hi)
            met = np.lib.stride_tricks.sliding_window_view(y, hi)[days - places - first] * x if hi else np.zeros((block, 0))
            run_up = np.concatenate([np.zeros((block, 1)), np.cumsum(met, axis=1)], axis=1)
            out.append(np.bincount(slot, (whole[:, None] - run_up[:, lo : hi + 1])[valid], (block + size) * bins))
        some = np.flatnonzero(np.bincount(slot, minlength=(block + size) * bins))
        turned = start - hi + some // bins
        return pd.DataFrame({**dict(zip(keys, key)), "shift": turned if sign > 0 else days - turned, "_b": some % bins + low, "pairs": np.rint(out[0][some]), "_s": out[1][some]})

    return parts.groupBy(*by, "_j").applyInPandas(run, f"{kinds(a, keys)}shift long, _b long, pairs double, _s double")
