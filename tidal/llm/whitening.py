"""Whitening of embedding vectors by a tall-skinny QR factorisation.

Entries become integers x = floor(scale * entry), so that sums over any number of
vectors are exact.  The fit list holds each distinct integer vector once.  Its rows
are centred by the exact sums; every task reduces its centred rows, block by block,
to one triangular factor; factors are merged pairwise up a tree; the singular values
and right vectors of the last one give the components, and no covariance is formed.
Only that last factor (as many rows and columns as a vector has entries) and sums of
that size reach the driver.

Defined results: rows without a vector, or whose vector holds a null or an entry that
isn't finite, are dropped; equal rows are fitted once and each returned; a null vec_id is
kept; a vector shorter than the longest counts as followed by zeros; an empty table, or
one of empty vectors, gives an empty result; entries beyond a long's range once scaled
take the nearest long.  A component without variance has whitened null and explained 0
(null where no component has any).  Components of equal variance are any basis of their
space, fixed for all rows; a component's sign is that which makes its largest entry
positive.  A deviation beyond a long's range is null.  Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ensure_session, lean, shared_folder

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Rows of a block that a task factors at once.
BLOCK = 2048
HIGH = 1 << 62


def usable(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x): the rows whose vector is whole and finite, its entries as integers."""
    entry = f"aggregate(`{column}`, true, (ok, e) -> ok AND e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity'))"
    # a double's floor is a long that stops at the ends of its range
    whole = F.expr(f"transform(`{column}`, e -> floor({scale} * double(e)))")
    return vectors.where(F.col(column).isNotNull() & F.expr(entry)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of width entries, shorter lists followed by zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Centre(NamedTuple):
    """Number of vectors, and exact sums of their entries."""

    n: int
    sums: tuple[int, ...]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once where n * x - S fits a long."""
        if self.fits(x):
            return (x * self.n - np.array(self.sums, dtype=np.int64)) / self.n
        mean = [Fraction(s, self.n) for s in self.sums]
        return np.array([[float(int(v) - m) for v, m in zip(row, mean)] for row in x.tolist()]).reshape(x.shape)

    def fits(self, x: np.ndarray) -> bool:
        return bool(len(x)) and self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums)) < HIGH

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2 in integers."""
        if self.fits(x):
            d = x * self.n - np.array(self.sums, dtype=np.int64)
            if int(np.abs(d).max()) ** 2 * d.shape[1] < HIGH:
                return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def _sums(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per task: rows, and sums of the entries' upper and lower 32 bits, which can't overflow."""
    n, high, low = 0, np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
    for batch in batches:
        x = _matrix(batch.column(0), width)
        n += len(x)
        high += (x >> 32).sum(axis=0)
        low += (x & 0xFFFFFFFF).sum(axis=0)
    yield _one(np.concatenate([[n], high, low]).astype(np.int64))


def _one(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(values).tobytes()], type=pa.binary())], names=["packed"])


def _factor(batches: Iterable[pa.RecordBatch], centre: Centre) -> Iterator[pa.RecordBatch]:
    """Per task: the triangular factor of its centred rows."""
    width = len(centre.sums)
    r = np.zeros((0, width))
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            r = triangle(np.vstack([r, centre.rows(_matrix(batch.column(0).slice(a, BLOCK), width))]))
    yield _one(r)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows' QR factorisation, with no more rows than columns."""
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def _tree(partials: DataFrame, merge) -> bytes:
    """Merges what tasks yield, pairwise on the executors and level by level."""
    rows = partials.rdd.map(lambda r: bytes(r[0]))
    depth = max(2, int(np.ceil(np.log2(max(rows.getNumPartitions(), 1)) / 4)))
    return rows.treeReduce(merge, depth)


def _merge_triangles(width: int):
    return lambda a, b: triangle(np.vstack([np.frombuffer(a).reshape(-1, width), np.frombuffer(b).reshape(-1, width)])).tobytes()


def _merge_sums(a: bytes, b: bytes) -> bytes:
    """Adds packed longs, carrying what the lower halves exceed 32 bits by into the upper ones."""
    both = np.frombuffer(a, dtype=np.int64) + np.frombuffer(b, dtype=np.int64)
    half = (len(both) + 1) // 2
    both[1:half] += both[half:] >> 32
    both[half:] &= 0xFFFFFFFF
    return both.tobytes()


def _merge_moments(k: int):
    """Joins packed (n, means, centred products) of two sets of rows."""

    def merge(a: bytes, b: bytes) -> bytes:
        u, v = np.frombuffer(a), np.frombuffer(b)
        if not u[0] or not v[0]:
            return a if u[0] else b
        n = u[0] + v[0]
        apart = v[1 : k + 1] - u[1 : k + 1]
        mean = u[1 : k + 1] + apart * (v[0] / n)
        products = u[k + 1 :] + v[k + 1 :] + np.outer(apart, apart).ravel() * (u[0] * v[0] / n)
        return np.concatenate([[n], mean, products]).tobytes()

    return merge


class Whitening(NamedTuple):
    """A fitted whitening: centre, components as columns scaled to unit variance (nan without variance), their shares of the variance, and the largest error of the identity."""

    centre: Centre
    scaled: np.ndarray
    explained: tuple[float | None, ...]
    identity_error: float | None

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.scaled


def fit(points: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of rows x (arrays of long), each distinct one counted once; None without entries."""
    spark = points.sparkSession
    ensure_session(spark)
    folder = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    points.select("x").distinct().write.parquet(folder)
    listed = spark.read.parquet(folder)
    width = listed.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    packed = np.frombuffer(_tree(listed.mapInArrow(lambda it: _sums(it, width), "packed binary"), _merge_sums), dtype=np.int64).tolist()
    centre = Centre(packed[0], tuple((h << 32) + low for h, low in zip(packed[1 : width + 1], packed[width + 1 :])))
    last = np.frombuffer(_tree(listed.mapInArrow(lambda it: _factor(it, centre), "packed binary"), _merge_triangles(width))).reshape(-1, width)
    k = min(components, width)
    singular, right = np.zeros(width), np.eye(width)
    if len(last):
        found, right = np.linalg.svd(last, full_matrices=True)[1:]
        singular[: len(found)] = found
    vectors = right[:k].T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    has = singular[:k] > singular[0] * width * np.finfo(float).eps
    deviation = singular[:k] / np.sqrt(centre.n)
    scaled = np.divide(vectors, deviation, out=np.full(vectors.shape, np.nan), where=np.broadcast_to(has, vectors.shape))
    total = float((singular**2).sum())
    shares = tuple(float(s * s) / total if total else None for s in np.where(has, singular[:k], 0.0))
    known = scaled[:, has]
    m = known.shape[1]

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, so_far = _merge_moments(m), np.zeros(1 + m + m * m).tobytes()
        for batch in batches:
            w = centre.rows(_matrix(batch.column(0), width)) @ known
            if len(w):
                off = w - w.mean(axis=0)
                so_far = merge(so_far, np.concatenate([[len(w)], w.mean(axis=0), (off.T @ off).ravel()]).tobytes())
        yield _one(np.frombuffer(so_far))

    error = None
    if m:
        found = np.frombuffer(_tree(listed.mapInArrow(moments, "packed binary"), _merge_moments(m)))
        error = float(np.abs(found[m + 1 :].reshape(m, m) / found[0] - np.eye(m)).max())
    return Whitening(centre, scaled, shares, error)


def whiten(vectors: DataFrame, components: int = 4, column: str = "embedding", scale: int = 256) -> DataFrame:
    """One row per usable vector and component (see the module's text)."""
    points = usable(vectors, column, scale)
    model = fit(points, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    k, width = model.scaled.shape[1], len(model.centre.sums)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch.column(1), width), batch.num_rows
            w = model.apply(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.centre.n)),
                    pa.array([d for d in model.centre.deviations(x) for _ in range(k)], type=pa.int64()),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(list(model.explained) * rows, type=pa.float64()),
                    pa.array([model.identity_error] * (rows * k), type=pa.float64()),
                ],
                names=names,
            )

    return points.mapInArrow(lean(run), SCHEMA)
