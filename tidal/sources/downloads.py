"""Downloads by tasks, in byte ranges that can be taken up again, and digests of files as streams.

A file is fetched in ranges, a task each, into parts beside its place; a part counts when
its digest file is there, so that a second call fetches what is missing only.  Parts are
then joined by a task in order, each held to its digest, under another name that becomes
the file's own at the end.  Nothing passes through the driver but names, sizes and digests.
"""

from __future__ import annotations

import hashlib
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

BLOCK = 1 << 20
#: A transport gives the size of a file, or blocks of the bytes from start up to stop.
Ranged = Callable[[str, int, int], Iterable[bytes]]


def http_size(url: str) -> int:
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as r:
        return int(r.headers["Content-Length"])


def http_range(url: str, start: int, stop: int) -> Iterator[bytes]:
    """Blocks of a byte range; a server that sends the whole file instead is read up to the range and no further."""
    request = urllib.request.Request(url, headers={"Range": f"bytes={start}-{stop - 1}"})
    with urllib.request.urlopen(request, timeout=60) as r:
        skip = 0 if r.status == 206 else start
        while skip and (block := r.read(min(BLOCK, skip))):
            skip -= len(block)
        left = stop - start
        while left and (block := r.read(min(BLOCK, left))):
            left -= len(block)
            yield block


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path.removeprefix("file:"))


def _exists(system: arrow_fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != arrow_fs.FileType.NotFound


def _fetch_part(system: arrow_fs.FileSystem, folder: str, url: str, start: int, stop: int, transport: Ranged) -> str:
    """Digest of a part, fetched unless it is there; a short answer raises OSError and leaves no part."""
    part = f"{folder}/{start:020d}"
    if _exists(system, f"{part}.sha256"):
        with system.open_input_stream(f"{part}.sha256") as f:
            return f.read().decode()
    digest, size = hashlib.sha256(), 0
    with system.open_output_stream(part) as f:
        for block in transport(url, start, stop):
            digest.update(block)
            size += len(block)
            f.write(block)
    if size != stop - start:
        raise OSError(f"{url}: {size} bytes of {stop - start} from {start}")
    with system.open_output_stream(f"{part}.sha256") as f:
        f.write(digest.hexdigest().encode())
    return digest.hexdigest()


def _join(system: arrow_fs.FileSystem, folder: str, target: str, starts: Sequence[int]) -> tuple[int, str]:
    """Size and digest of the parts joined under target, each held to its digest."""
    whole, size = hashlib.sha256(), 0
    with system.open_output_stream(f"{target}.joining") as out:
        for start in sorted(starts):
            own = hashlib.sha256()
            with system.open_input_stream(f"{folder}/{start:020d}") as f:
                while block := f.read(BLOCK):
                    own.update(block)
                    whole.update(block)
                    size += len(block)
                    out.write(block)
            with system.open_input_stream(f"{folder}/{start:020d}.sha256") as f:
                if f.read().decode() != own.hexdigest():
                    raise OSError(f"part {start} of {target} isn't what was fetched")
    system.move(f"{target}.joining", target)
    return size, whole.hexdigest()


def download(spark: SparkSession, files: Sequence[tuple[str, str]], part_bytes: int = 64 << 20, size: Callable[[str], int] = http_size, transport: Ranged = http_range) -> DataFrame:
    """Fetches (url, path) files, paths in a folder that all executors share; (url, path, bytes, sha256) of each.

    An empty file has no parts and is made by the joining task.  A call that failed can be
    made again: parts that are there aren't fetched anew.
    """
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    named = spark.createDataFrame(list(files), "url string, path string").repartition(cores, "path")

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([size(u) for u in b.column(0).to_pylist()], type=pa.int64())], names=["url", "path", "bytes"])

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                system, path = _place(r["path"])
                system.create_dir(f"{path}.parts", recursive=True)
                if r["start"] is not None:
                    _fetch_part(system, f"{path}.parts", r["url"], r["start"], min(r["start"] + part_bytes, r["bytes"]), transport)
            yield b

    def join(key: tuple, part: pa.Table) -> pa.Table:
        url, path = (k.as_py() for k in key)
        system, place = _place(path)
        n, digest = _join(system, f"{place}.parts", place, [x for x in part.column("start").to_pylist() if x is not None])
        system.delete_dir(f"{place}.parts")
        return pa.table({"url": [url], "path": [path], "bytes": [n], "sha256": [digest]})

    measured = named.mapInArrow(sizes, "url string, path string, bytes long")
    starts = F.when(F.col("bytes") > 0, F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(part_bytes).cast("long")))
    ranges = measured.select("url", "path", "bytes", F.explode_outer(starts).alias("start")).repartition(cores, "path", "start")
    done = ranges.mapInArrow(fetch, "url string, path string, bytes long, start long").groupBy("url", "path").applyInArrow(join, "url string, path string, bytes long, sha256 string")
    found = [tuple(r) for r in done.collect()]  # one row a file asked for
    return spark.createDataFrame(found, "url string, path string, bytes long, sha256 string")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files that a path pattern names, read as streams by tasks."""
    ship(spark)
    named = spark.read.format("binaryFile").load(path).select("path", "length").repartition(spark.sparkContext.defaultParallelism, "path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                system, place = _place(name)
                digest = hashlib.sha256()
                with system.open_input_stream(place) as f:
                    while block := f.read(BLOCK):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, type=pa.string())], names=["path", "bytes", "sha256"])

    return named.mapInArrow(run, "path string, bytes long, sha256 string")
