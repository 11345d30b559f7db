"""Sums over lags of two series, by Fourier transforms of day blocks.

The positions of the later-lagged series are dealt to blocks of equal length; the other
series goes to every block that one of its lags reaches, so that a row is copied two or
three times and not once a lag.  A block's sums over all lags are one product of
transforms; sums over blocks follow in a partial aggregation.  A group is as long as a
block and its halo, however long the series.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a block, at least.
LEAST = 512


class Term(NamedTuple):
    """A sum over pairs of a factor of x times a factor of y, as SQL; of: the count term of the pairs that enter, or None for a count."""

    x: str
    y: str
    of: str | None = None


def kinds(rows: DataFrame, names: Sequence[str]) -> str:
    """The named columns as a schema string that ends in a comma."""
    types = dict(rows.dtypes)
    return "".join(f"`{n}` {types[n]}, " for n in names)


def lagged_sums(a: DataFrame, b: DataFrame, keys: Sequence[str], lo: int, hi: int, terms: dict[str, Term], at: str = "day") -> DataFrame:
    """(keys, lag, terms): sums over positions t of the terms of x, the value of a at t + lag, and y, that of b at t, for lags lo to hi.

    The first term counts pairs, and lags without a pair are
    left out.  Rows that share a position pair with all of the other side.
    """
    length = max(hi - lo + 1, LEAST)
    order = list(terms)
    left, right = (list(dict.fromkeys(f)) for f in ((t.x for t in terms.values()), (t.y for t in terms.values())))
    of_x, of_y = [left.index(t.x) for t in terms.values()], [right.index(t.y) for t in terms.values()]
    p = F.col(at).cast("long")
    floor = lambda c: F.floor(c / length).cast("long")
    early = b.select(*keys, floor(p).alias("_block"), F.lit(1).alias("_side"), p.alias("_p"), F.col("value").alias("y")).select(*keys, "_block", "_side", "_p", F.array(*(F.expr(f"CAST({c} AS DOUBLE)") for c in right)).alias("_v"))
    late = a.select(*keys, F.explode(F.sequence(floor(p - hi), floor(p - lo))).alias("_block"), F.lit(0).alias("_side"), p.alias("_p"), F.col("value").alias("x")).select(*keys, "_block", "_side", "_p", F.array(*(F.expr(f"CAST({c} AS DOUBLE)") for c in left)).alias("_v"))
    masks = [order.index(terms[n].of or n) for n in order]
    counts = [terms[n].of is None for n in order]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        side, start = part["_side"].to_numpy(), int(key[-1]) * length
        if side.min() == side.max():
            return pd.DataFrame(columns=[*keys, "lag", *order])
        place, values = part["_p"].to_numpy(), np.stack(part["_v"].to_numpy())
        x = _laid(place[side == 0] - start - lo, values[side == 0], length + hi - lo)
        y = _laid(place[side == 1] - start, values[side == 1], length)
        n = 1 << (2 * length + hi - lo).bit_length()
        fx, fy = np.fft.rfft(x, n), np.conj(np.fft.rfft(y, n))
        sums = np.fft.irfft(fx[of_x] * fy[of_y], n)[:, : hi - lo + 1]
        sums[counts] = np.rint(sums[counts])
        sums = np.where(sums[masks] > 0, sums, 0.0)
        some = sums[0] > 0
        return pd.DataFrame({**dict(zip(keys, key)), "lag": np.arange(lo, hi + 1)[some], **{c: s[some] for c, s in zip(order, sums)}})

    sums = late.unionByName(early).groupBy(*keys, "_block").applyInPandas(run, f"{kinds(a, keys)}lag long, " + ", ".join(f"{n} double" for n in order))
    return sums.groupBy(*keys, "lag").agg(*(F.sum(n).cast("long" if c else "double").alias(n) for n, c in zip(order, counts)))


def _laid(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Columns of values at their places in rows of n, summed where places are equal."""
    return np.stack([np.bincount(place, weights=v, minlength=n) for v in values.reshape(len(place), -1).T])
