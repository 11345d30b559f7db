"""Where files that driver and executors share are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; an own one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="tidal-")
    return _own[context.applicationId]


def written(rows: DataFrame) -> DataFrame:
    """rows as read back from a table in the shared folder, for what is used many times; a lost executor costs no more than reading it again."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
