"""Results of phases as nested documents under immutable runs.

A run is one folder of JSON documents, one a channel, nested by band, variant and branch,
beside a manifest that names the phase, its settings and the runs it rests on.  The
manifest is created last and never replaced, so that a run without one was not finished
and isn't seen.  Later phases read a run by its name, or look tests up by key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Levels of a document below its channel, outermost first.
LEVELS = ("band", "variant", "branch")


def nested(rows: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """(channel, tests) of rows (channel, levels, others): maps by the levels' values, innermost structs of the other columns.  A key's rows are a handful."""
    others = [c for c in rows.columns if c not in ("channel", *levels)]
    got = rows.select("channel", *levels, F.struct(*others).alias("tests"))
    for i in range(len(levels) - 1, -1, -1):
        entries = F.map_from_entries(F.collect_list(F.struct(F.col(levels[i]).alias("k"), F.col("tests").alias("v"))))
        got = got.groupBy("channel", *levels[:i]).agg(entries.alias("tests"))
    return got


def flat(documents: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Rows (channel, levels, others) of nested documents."""
    got = documents.select("channel", "tests")
    for i, level in enumerate(levels):
        got = got.select("channel", *levels[:i], F.explode("tests").alias(level, "tests"))
    return got.select("channel", *levels, "tests.*")


class PhaseStore:
    """Runs of phases below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, phase: str, rows: DataFrame, settings: dict | None = None, parents: Sequence[str] = ()) -> str:
        """Writes rows (channel, band, variant, branch, others) as a new run that rests on the parent runs; returns its name."""
        for parent in parents:
            self.manifest(parent)
        run = f"{phase}-{uuid.uuid4().hex}"
        documents = nested(rows)
        documents.select(F.to_json(F.struct("channel", "tests"), {"ignoreNullFields": "false"}).alias("document")).write.text(f"{self.folder}/{run}/documents")
        schema = documents.select("channel", "tests").schema.jsonValue()
        self._create(run, {"phase": phase, "run": run, "settings": settings or {}, "parents": list(parents), "schema": schema})
        return run

    def _create(self, run: str, manifest: dict) -> None:
        path, fs = self._path(run, "manifest.json")
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def manifest(self, run: str) -> dict:
        """The manifest of a finished run; KeyError where there is none."""
        path, fs = self._path(run, "manifest.json")
        if not fs.exists(path):
            raise KeyError(f"no finished run {run!r}")
        text = self.spark.read.text(path.toString(), wholetext=True).first()[0]
        return json.loads(text)

    def runs(self, phase: str) -> list[str]:
        """Finished runs of a phase, by time of their manifests, the latest last."""
        path, fs = self._path("*", "manifest.json")
        found = sorted((f.getModificationTime(), f.getPath().getParent().getName()) for f in fs.globStatus(path) or [])
        return [run for _, run in found if run.rsplit("-", 1)[0] == phase]

    def lineage(self, run: str) -> list[str]:
        """The run and all runs it rests on, each once, parents after children; KeyError where one is missing."""
        seen, open_ = [], [run]
        while open_:
            at = open_.pop(0)
            if at not in seen:
                seen.append(at)
                open_ += self.manifest(at)["parents"]
        return seen

    def documents(self, run: str) -> DataFrame:
        schema = StructType.fromJson(self.manifest(run)["schema"])
        lines = self.spark.read.text(f"{self.folder}/{run}/documents")
        return lines.select(F.from_json("value", schema).alias("d")).select("d.*")

    def read(self, run: str) -> DataFrame:
        """The rows of a run."""
        return flat(self.documents(run))

    def lookup(self, run: str, rows: DataFrame, on: Sequence[str] | None = None, columns: Sequence[str] = ("p", "p_holm", "q_bh")) -> DataFrame:
        """rows with columns of the run's tests of the same key (channel and levels, or those of on), null where it has none."""
        keys = list(on or ("channel", *LEVELS))
        return rows.join(self.read(run).select(*keys, *columns), keys, "left")
