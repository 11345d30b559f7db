"""Red-noise surrogates: a linear recurrence over day blocks, driven by noise that is addressed by number.

Every innovation is a function of (seed, stream, simulation, day), so that any task can
make those of any stretch of days again.  Within a block of days the recurrence is an
affine map of the value before it: phi to the power of its days, and the block's own
noise from a zero start.  Blocks give their own noise in parallel, a scan over blocks
composes the maps to the value before each, and whoever needs days of a block adds the two.
Nothing depends on the blocks' length, on batches or on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import kinds

#: Days of a block, days within one matrix product, and simulations of a batch.
BLOCK, STEP, BATCH = 512, 64, 50
LOW = np.uint64(0xFFFFFFFF)
#: Multipliers and shifts of a 32-bit mixing function, and what tells the second uniform number from the first.
FIRST, SECOND, SHIFTS, OTHER = 0x21F0AAAD, 0x735A2D97, (16, 15, 15), 0x5BD1E995


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, mixed one to one."""
    x = np.asarray(x).astype(np.uint64) & LOW
    x = (x ^ x >> np.uint64(SHIFTS[0])) * np.uint64(FIRST) & LOW
    x = (x ^ x >> np.uint64(SHIFTS[1])) * np.uint64(SECOND) & LOW
    return x ^ x >> np.uint64(SHIFTS[2])


def bits(stream: int, seed: int, sims: np.ndarray, days: np.ndarray) -> np.ndarray:
    """A 32-bit number for every simulation (rows) and day (columns)."""
    own = mixed(mixed(np.uint64(stream) ^ mixed(seed)) ^ mixed(sims))
    return mixed(own[:, None] ^ mixed(days.astype(np.int64))[None, :])


def uniform(x: np.ndarray) -> np.ndarray:
    return (x.astype(float) + 0.5) / 2.0**32


def normal(stream: int, seed: int, sims: np.ndarray, days: np.ndarray) -> np.ndarray:
    """Standard normal numbers from two uniform ones (Box-Muller)."""
    x = bits(stream, seed, sims, days)
    return np.sqrt(-2 * np.log(uniform(x))) * np.cos(2 * np.pi * uniform(mixed(x ^ np.uint64(OTHER))))


def stream(keys: Sequence[str]) -> Column:
    """The number of a key's noise: the leading 32 bits of the MD5 of its values."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys))), 1, 8), 16, 10).cast("long")


class Recurrence(NamedTuple):
    """x[t] = phi x[t - 1] + noise of variance 1 - phi^2 from day first on; x[first] is a standard normal number where stationary, else 0."""

    stream: int
    seed: int
    phi: float
    first: int
    stationary: bool = True
    block: int = BLOCK

    def from_zero(self, sims: np.ndarray, block: int) -> np.ndarray:
        """A block's values by simulation if those before it were 0."""
        days = block * self.block + np.arange(self.block)
        e = normal(self.stream, self.seed, sims, days)
        scale = np.where(days > self.first, np.sqrt(max(1e-12, 1 - self.phi**2)), np.where(days == self.first, float(self.stationary), 0.0))
        steps = np.subtract.outer(np.arange(STEP), np.arange(STEP))
        within = np.where(steps >= 0, float(self.phi) ** np.maximum(steps, 0), 0.0)
        out = np.concatenate([e * scale, np.zeros((len(sims), -self.block % STEP))], axis=1).reshape(len(sims), -1, STEP) @ within.T
        fade = float(self.phi) ** np.arange(1, STEP + 1)
        for i in range(1, out.shape[1]):
            out[:, i] += fade * out[:, i - 1, -1:]
        return out.reshape(len(sims), -1)[:, : self.block]

    def starts(self, ends: np.ndarray) -> np.ndarray:
        """Values before each block, by simulation, from the ends of consecutive blocks from zero: the scan of the affine maps."""
        out = np.zeros_like(ends)
        for b in range(1, ends.shape[1]):
            out[:, b] = ends[:, b - 1] + float(self.phi) ** self.block * out[:, b - 1]
        return out

    def values(self, sims: np.ndarray, days: np.ndarray, starts: np.ndarray, first_block: int) -> np.ndarray:
        """Values by simulation on the given days, from the values before each block."""
        out = np.empty((len(sims), len(days)))
        of = days // self.block
        fade = float(self.phi) ** np.arange(1, self.block + 1)
        for b in np.unique(of).tolist():
            here = of == b
            all_days = self.from_zero(sims, b) + fade * starts[:, b - first_block, None]
            out[:, here] = all_days[:, days[here] - b * self.block]
        return out


class Surrogates(NamedTuple):
    """Surrogates of many series: states has the keys, _stream, _phi, _first, _batch, _block (the first one) and _starts, for batches of simulations."""

    states: DataFrame
    keys: Sequence[str]
    simulations: int
    seed: int
    stationary: bool

    def apply(self, units: DataFrame, run: Callable[[pd.Series, np.ndarray, Callable[[np.ndarray], np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
        """The rows that run makes of every row of units (keys and others) and every batch: run(row, simulations, values), where values(days) gives surrogates by simulation.

        The keys and schema are the result's columns.
        """
        keys, seed, simulations, stationary = list(self.keys), self.seed, self.simulations, self.stationary
        cores = units.sparkSession.sparkContext.defaultParallelism
        work = units.join(self.states, keys).repartition(2 * cores, *keys, *(c for c in units.columns if c not in keys and dict(units.dtypes)[c] in ("int", "bigint")), "_batch")

        def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for _, row in part.iterrows():
                    model = Recurrence(row["_stream"], seed, row["_phi"], row["_first"], stationary)
                    sims = np.arange(row["_batch"] * BATCH, min(simulations, (row["_batch"] + 1) * BATCH))
                    starts = np.asarray(row["_starts"]).reshape(len(sims), -1)
                    got = run(row, sims, lambda days, m=model, s=sims, x=starts, b=row["_block"]: m.values(s, days, x, b))
                    yield got.assign(**{k: row[k] for k in keys})[[*keys, *(c for c in got.columns if c not in keys)]]

        return work.mapInPandas(each, kinds(units, keys) + schema)


def surrogates(rows: DataFrame, phi: DataFrame, keys: Sequence[str], simulations: int, seed: int, stationary: bool = True, at: str = "day") -> Surrogates:
    """Surrogates of each key's rows (keys, at) with the phi (keys, phi) given."""
    keys, cores = list(keys), rows.sparkSession.sparkContext.defaultParallelism
    place = F.col(at).cast("long")
    ends = rows.groupBy(*keys).agg(F.min(place).alias("_first"), F.max(place).alias("_last")).join(phi.select(*keys, F.col("phi").alias("_phi")), keys).withColumn("_stream", stream(keys))
    batches = ends.withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit((simulations - 1) // BATCH))))
    work = batches.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / BLOCK).cast("long"), F.floor(F.col("_last") / BLOCK).cast("long"))))
    work = work.select(*keys, "_stream", "_phi", "_first", "_batch", "_block").repartition(2 * cores, *keys, "_batch", "_block")
    base = f"{kinds(rows, keys)}_stream long, _phi double, _first long, _batch int, _block long, "

    def own_noise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = []
            for r in part.itertuples(index=False):
                sims = np.arange(r[-2] * BATCH, min(simulations, (r[-2] + 1) * BATCH))
                got.append(Recurrence(r[-5], seed, r[-4], r[-3], stationary).from_zero(sims, r[-1])[:, -1])
            yield part.assign(_ends=got)

    def scan(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_block")
        first = part.iloc[:1]
        model = Recurrence(int(first["_stream"].iloc[0]), seed, float(first["_phi"].iloc[0]), int(first["_first"].iloc[0]), stationary)
        return first.drop(columns="_ends").assign(_starts=[model.starts(np.stack(part["_ends"].to_numpy(), axis=1)).ravel()])

    states = work.mapInPandas(own_noise, base + "_ends array<double>").groupBy(*keys, "_batch").applyInPandas(scan, base + "_starts array<double>")
    return Surrogates(states, keys, simulations, seed, stationary)


def long_rows(found: Surrogates, rows: DataFrame, at: str = "day") -> DataFrame:
    """(keys, sim, at, value): the surrogates on the rows' own days."""
    days = rows.groupBy(*found.keys, F.floor(F.col(at) / BLOCK).alias("_of")).agg(F.sort_array(F.collect_list(F.col(at).cast("long"))).alias("_days"))

    def run(row: pd.Series, sims: np.ndarray, values: Callable) -> pd.DataFrame:
        days = np.asarray(row["_days"])
        return pd.DataFrame({"sim": np.repeat(sims, len(days)), at: np.tile(days, len(sims)), "value": values(days).ravel()})

    return found.apply(days, run, f"sim int, {at} long, value double")
