"""Helpers for rows that carry texts through a shuffle, and for checkpoint folders."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of texts that a task takes at once, where the session leaves Spark's default of 10,000.
BATCH_ROWS = 2000
_codec: list = []


def lean(task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """task, and at its end the memory that it freed goes back to the system, as workers live on between tasks.

    Called on the driver, where it makes the package importable in the session's workers.
    """
    if spark := SparkSession.getActiveSession():
        ensure_session(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def inflate(packed: bytes) -> bytes:
    if not _codec:
        _codec[:] = [zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()]
    return _codec[1].decompress(packed) if packed else b""


def deflate(text: bytes) -> bytes:
    if not _codec:
        _codec[:] = [zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()]
    return _codec[0].compress(text) if text else b""


def squeezed(rows: DataFrame) -> DataFrame:
    """Rows with the column text (null: empty) replaced by packed, its compressed bytes; it comes last."""
    others = [c for c in rows.columns if c != "text"]
    kept = rows.select(*others, F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["packed binary"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([deflate(x.as_buffer().to_pybytes()) for x in batch.column(len(others))], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=[*others, "packed"])

    return kept.mapInArrow(lean(run), schema)


def unused(rows: DataFrame, name: str) -> str:
    """name, or name with underscores put before it until rows have no such column."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ensure_session(spark: SparkSession) -> None:
    """Makes the package importable in workers.  Uses the session's spark.checkpoint.dir; sets a folder of its own only where none is set on a local master, as in tests."""
    ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidal-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors share."""
    ensure_session(spark)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get() if own.isDefined() else spark.conf.get("spark.checkpoint.dir")
