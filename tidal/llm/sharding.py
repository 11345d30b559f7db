"""Size-tiered compaction of immutable document shards under a versioned manifest.

A store is a folder with ``data`` (Parquet shards, never changed) and
``manifest`` (one JSON file per version, listing the live shards with rows and
bytes).  ``append`` writes arrivals as small shards; ``compact`` merges the
shards of one size tier after the other, once a tier has ``fan_in`` of them, into files
of about the target size; ``vacuum`` deletes files that no manifest still in use lists.
Every change commits by renaming a complete manifest to the next version's name,
which fails if that version exists, so readers see all of a change or nothing,
and of two writers one has to try again.

Shards of a tier have similar sizes, so they are merged by coalescing the scan's
partitions: no shuffle, and a task holds one file at a time.  The driver handles
shard metadata only.

Defined results: rows come back as they were appended, nulls, repeated rows and
extra columns included; an empty table appends no shard but makes a version;
reading a store without shards gives an empty table with the manifest's schema; very
long texts are rows like others, and ties in size are merged together.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionConflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}.json"

    def version(self) -> int:
        """The last committed version, 0 for a new store."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, base: dict, shards: list[dict], schema: str, action: str) -> int:
        version = base["version"] + 1
        final, draft = self._path(self._manifest(version)), self._path(f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "action": action, "schema": schema, "shards": shards}).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise VersionConflict(f"version {version} of {self.root} exists")
        return version

    # shards

    def _write(self, rows: DataFrame, most_rows: int = 0) -> list[dict]:
        """Writes a new folder, a task's rows in files of most_rows at most (0: in one), and lists its files with more than no rows, which a job counts by their footers."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", most_rows).parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder)
        file = written.metadataColumn("_metadata")
        counts = written.groupBy(file["file_name"].alias("name"), file["file_size"].alias("bytes")).agg(F.count("*").alias("rows"))
        return [{"path": f"{folder[len(self.root) + 1 :]}/{r['name']}", "rows": r["rows"], "bytes": r["bytes"]} for r in counts.collect()]

    def tier(self, size: int) -> int:
        """0 for shards of the target size or more; each further tier is fan_in times smaller."""
        return max(0, math.ceil(math.log(self.target / max(size, 1), self.fan_in) - 1e-9))

    def append(self, rows: DataFrame) -> int:
        """Adds rows as shards of their own; returns the new version."""
        base = self.manifest()
        schema = base["schema"] or rows.schema.json()
        if json.loads(rows.schema.json()) != json.loads(schema):
            raise ValueError("the rows' schema differs from the store's")
        return self._commit(base, base["shards"] + self._write(rows), schema, "append")

    def compact(self) -> int:
        """Merges tiers, that of the smallest shards first, until none but the largest holds fan_in shards; returns the version."""
        version, left = self.version(), set()
        while True:
            base = self.manifest(version)
            tiers: dict[int, list[dict]] = {}
            for s in base["shards"]:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
            full = [t for t, shards in tiers.items() if t > 0 and t not in left and len(shards) >= self.fan_in]
            if not full:
                return version
            merged = tiers[max(full)]
            size, rows = (sum(s[c] for s in merged) for c in ("bytes", "rows"))
            files = max(1, round(size / self.target))
            old = {s["path"] for s in merged}
            # a scan's splits may be larger than the target, so a task's rows are cut by their number as well
            fresh = self._write(self._rows(merged, base["schema"]).coalesce(files), math.ceil(1.25 * rows / files))
            version = self._commit(base, [s for s in base["shards"] if s["path"] not in old] + fresh, base["schema"], "compact")
            if len(fresh) >= len(merged):
                left.add(max(full))

    def _rows(self, shards: list[dict], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.root}/{s['path']}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store has no version yet")
        return self._rows(m["shards"], m["schema"])

    def shards(self, version: int | None = None) -> DataFrame:
        """(path, rows, bytes, tier) of a version."""
        rows = [(s["path"], s["rows"], s["bytes"], self.tier(s["bytes"])) for s in self.manifest(version)["shards"]]
        return self.spark.createDataFrame(rows, "path string, rows long, bytes long, tier int")

    def vacuum(self, keep: int = 1, orphans_after: float = 86_400) -> int:
        """Deletes shard files that none of the last keep versions lists, and files that no version ever listed (of writers that failed) once they are orphans_after seconds old; returns how many."""
        last = self.version()
        live = {s["path"] for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)["shards"]}
        gone = {s["path"] for v in range(1, last + 1) if self._fs.exists(self._path(self._manifest(v))) for s in self.manifest(v)["shards"]} - live
        data = self._path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else ():
            for s in self._fs.listStatus(folder.getPath()):
                path = f"data/{folder.getPath().getName()}/{s.getPath().getName()}"
                if path not in live and path.endswith(".parquet") and s.getModificationTime() / 1000 < time.time() - orphans_after:
                    gone.add(path)
        return sum(bool(self._fs.delete(self._path(f"{self.root}/{p}"), False)) for p in sorted(gone))


def shard_documents(docs: DataFrame, root: str, arrivals: int = 4, target_bytes: int = 32 << 20) -> Store:
    """A new store that takes docs in arrivals (by a hash of doc_id), compacts and vacuums."""
    store = Store(docs.sparkSession, root, target_bytes)
    for i in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == i))
    store.compact()
    store.vacuum()
    return store
