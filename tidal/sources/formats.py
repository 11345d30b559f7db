"""A measurement service and a committing folder of records as formats of Spark's readers and writers.

``spark.read.format("measurement_service")`` reads a data set of a service, a task a calendar
year; bounds on the time column narrow the years and the requests within them, and the
option parameters chooses columns.  ``df.write.format("measurement_records")`` writes text
files whose digests, counts and field report appear at once, in one manifest, when all
tasks are done; ``spark.read.format("measurement_records")`` reads what a manifest names.
``register`` makes both known to a session.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

from pyarrow import fs as arrow_fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from ..shipping import ship
from .service import Service

#: Types of a service's parameters.
KINDS = {"isotime": TimestampType(), "double": DoubleType(), "integer": LongType()}
MANIFEST = "manifest.json"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets Spark hand them filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ServiceSource, RecordsSource):
        spark.dataSource.register(source)


# the service

def service_schema(parameters: Sequence[dict], wanted: Sequence[str] = ()) -> StructType:
    """The schema of a service's parameters: the first one, the time, and those wanted (all if none are named)."""
    kept = [p for i, p in enumerate(parameters) if i == 0 or not wanted or p["name"] in wanted]
    kind = lambda p: KINDS.get(p.get("type", "string"), StringType())
    return StructType([StructField(str(p["name"]), ArrayType(kind(p)) if p.get("size") else kind(p)) for p in kept])


def moment(text: str) -> datetime | None:
    """A time of a service, with the day by month or of the year, in UTC; None where it isn't one."""
    text = text.strip().removesuffix("Z")
    day, _, clock = text.partition("T")
    try:
        at = datetime.strptime(day, "%Y-%j") if len(day) == 8 and day.count("-") == 1 else datetime.fromisoformat(day)
        clock = time_of_day(clock)
    except ValueError:
        return None
    return (at + clock).replace(tzinfo=timezone.utc)


def time_of_day(text: str) -> timedelta:
    hours, minutes, seconds = ([float(x) for x in text.split(":")] if text else []) + [0.0] * (3 - (text.count(":") + 1 if text else 0))
    return timedelta(hours=hours, minutes=minutes, seconds=seconds)


@dataclass
class Year(InputPartition):
    """A request: from start up to stop, which is left out."""

    start: str
    stop: str


class ServiceSource(DataSource):
    """Options: url, dataset, start and stop (dates, both in), parameters (names, commas between), retries, pause."""

    @classmethod
    def name(cls) -> str:
        return "measurement_service"

    def _service(self) -> Service:
        return Service(self.options["url"], retries=int(self.options.get("retries", 2)), pause=float(self.options.get("pause", 0.5)))

    def wanted(self) -> list[str]:
        return [x.strip() for x in self.options.get("parameters", "").split(",") if x.strip()]

    def schema(self) -> StructType:
        return service_schema(self._service().info(self.options["dataset"]).parameters, self.wanted())

    def reader(self, schema: StructType) -> DataSourceReader:
        service = self._service()
        info = service.info(self.options["dataset"])
        day = lambda x: str(x)[:10]
        fills = {str(p["name"]): p.get("fill") for p in info.parameters}
        sizes = {str(p["name"]): math.prod(p["size"]) for p in info.parameters if p.get("size")}
        return ServiceReader(service, self.options["dataset"], day(self.options.get("start", info.start)), day(self.options.get("stop", info.stop)), self.wanted(), schema, fills, sizes)


class ServiceReader(DataSourceReader):
    def __init__(self, service: Service, dataset: str, start: str, stop: str, wanted: list[str], schema: StructType, fills: dict, sizes: dict):
        self.service, self.dataset, self.wanted, self.schema, self.fills, self.sizes = service, dataset, wanted, schema, fills, sizes
        self.start, self.stop = date.fromisoformat(start), date.fromisoformat(stop)

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Bounds on the time column narrow the days asked for; Spark applies every filter again."""
        time = (self.schema[0].name,)
        for f in filters:
            if getattr(f, "attribute", None) == time and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                day = f.value.astimezone(timezone.utc).date() if isinstance(f.value, datetime) else f.value
                if isinstance(day, date):
                    if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                        self.start = max(self.start, day)
                    if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                        self.stop = min(self.stop, day)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        if self.start > self.stop:
            return [Year("", "")]
        self.service.current_names()  # asked once, not by every task
        end = self.stop + timedelta(days=1)
        starts = [self.start, *(date(y, 1, 1) for y in range(self.start.year + 1, self.stop.year + 1))]
        return [Year(a.isoformat(), b.isoformat()) for a, b in zip(starts, [*starts[1:], end])]

    def read(self, partition: Year) -> Iterator[tuple]:
        if not partition.start:
            return
        names = [f.name for f in self.schema]
        for cells in csv.reader(self.service.lines(self.dataset, partition.start, partition.stop, self.wanted)):
            row, at = [], 0
            for name, kind in zip(names, (f.dataType for f in self.schema)):
                n = self.sizes.get(name)
                part = [self._value(x, name, kind.elementType if n else kind) for x in cells[at : at + (n or 1)]]
                row.append(part if n else part[0] if part else None)
                at += n or 1
            yield tuple(row)

    def _value(self, text: str, name: str, kind) -> object:
        fill = self.fills.get(name)
        if text == "" or fill is not None and (text.strip() == str(fill) or isinstance(kind, (DoubleType, LongType)) and _number(text) == _number(str(fill))):
            return None
        if isinstance(kind, TimestampType):
            return moment(text)
        if isinstance(kind, (DoubleType, LongType)):
            value = _number(text)
            return value if value is None or isinstance(kind, DoubleType) else int(value)
        return text


def _number(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


# records

@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its file, rows, bytes and digest, and per column the values present, finite and zero."""

    path: str
    rows: int = 0
    bytes: int = 0
    sha256: str = ""
    fields: dict = field(default_factory=dict)


class RecordsSource(DataSource):
    """CSV files under the option path, as named by its manifest."""

    @classmethod
    def name(cls) -> str:
        return "measurement_records"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(_read(self.options["path"], MANIFEST))["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordsReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordsWriter(self.options["path"], schema, overwrite)


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, one that Arrow knows."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path.removeprefix("file:"))


def _read(path: str, name: str) -> bytes:
    system, base = _place(path)
    with system.open_input_stream(f"{base}/{name}") as f:
        return f.read()


class RecordsWriter(DataSourceWriter):
    """Each task writes a file of its own; the driver's commit names all files in a manifest, which alone makes them readable."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.run = path.rstrip("/"), schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, base = _place(self.path)
        system.create_dir(f"{base}/{self.run}", recursive=True)
        out = Written(f"{self.run}/part-{uuid.uuid4().hex}.csv", fields={f.name: [0, 0, 0] for f in self.schema})
        digest, text = hashlib.sha256(), io.StringIO()
        line = csv.writer(text, lineterminator="\n", quoting=csv.QUOTE_NOTNULL)
        with system.open_output_stream(f"{base}/{out.path}") as f:
            for row in iterator:
                out.rows += 1
                for value, counts in zip(row, out.fields.values()):
                    if value is not None:
                        counts[0] += 1
                        counts[1] += not isinstance(value, float) or math.isfinite(value)
                        counts[2] += not isinstance(value, str) and value == 0
                line.writerow([_text(v) for v in row])
                if text.tell() > 1 << 20:
                    self._flush(f, text, digest, out)
            self._flush(f, text, digest, out)
        out.sha256 = digest.hexdigest()
        return out

    @staticmethod
    def _flush(f, text: io.StringIO, digest, out: Written) -> None:
        data = text.getvalue().encode()
        text.seek(0)
        text.truncate()
        digest.update(data)
        out.bytes += len(data)
        f.write(data)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _place(self.path)
        done = [m for m in messages if isinstance(m, Written)]
        there = system.get_file_info(f"{base}/{MANIFEST}").type != arrow_fs.FileType.NotFound
        before = json.loads(_read(self.path, MANIFEST))["files"] if there and not self.overwrite else []
        files = before + [{"path": m.path, "rows": m.rows, "bytes": m.bytes, "sha256": m.sha256, "fields": m.fields} for m in done]
        totals = {f.name: [sum(x["fields"][f.name][i] for x in files) for i in range(3)] for f in self.schema}
        rows = sum(x["rows"] for x in files)
        report = [{"field": n, "rows": rows, "present": p, "finite": q, "missing": rows - q, "zeros": z} for n, (p, q, z) in totals.items()]
        manifest = {"run": self.run, "schema": self.schema.jsonValue(), "rows": rows, "files": files, "report": report}
        with system.open_output_stream(f"{base}/{self.run}/{MANIFEST}") as f:
            f.write(json.dumps(manifest).encode())
        system.move(f"{base}/{self.run}/{MANIFEST}", f"{base}/{MANIFEST}")  # in place of an earlier one

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _place(self.path)
        if system.get_file_info(f"{base}/{self.run}").type != arrow_fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.run}")


def _text(value: object) -> str | None:
    """A value as text that reads back to it; null is an empty cell without quotes."""
    if value is None or isinstance(value, str):
        return value
    return repr(value) if isinstance(value, float) else value.isoformat() if isinstance(value, (date, datetime)) else str(value)


@dataclass
class File(InputPartition):
    path: str
    sha256: str


class RecordsReader(DataSourceReader):
    """A task reads a file of the manifest, and fails where its bytes aren't those that were written."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path.rstrip("/"), schema
        self.files = json.loads(_read(path, MANIFEST))["files"]

    def partitions(self) -> Sequence[InputPartition]:
        return [File(x["path"], x["sha256"]) for x in self.files] or [File("", "")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.path:
            return
        system, base = _place(self.path)
        digest = hashlib.sha256()
        with system.open_input_stream(f"{base}/{partition.path}") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        if digest.hexdigest() != partition.sha256:
            raise ValueError(f"{partition.path} isn't what its manifest says")
        kinds = [f.dataType.simpleString() for f in self.schema]
        with system.open_input_stream(f"{base}/{partition.path}") as f, io.TextIOWrapper(f, encoding="utf-8", newline="") as lines:
            for cells in csv.reader(lines, quoting=csv.QUOTE_NOTNULL):
                yield tuple(_typed(c, k) for c, k in zip(cells, kinds))


def _typed(cell: str | None, kind: str) -> object:
    if cell is None or kind == "string":
        return cell
    if kind in ("double", "float"):
        return float(cell)
    if kind == "boolean":
        return cell == "True"
    if kind == "date":
        return date.fromisoformat(cell)
    return datetime.fromisoformat(cell) if kind.startswith("timestamp") else int(cell)


def manifest(spark: SparkSession, path: str):
    """(path, rows, bytes, sha256) of the files of a written folder."""
    files = json.loads(_read(path, MANIFEST))["files"]
    return spark.createDataFrame([(x["path"], x["rows"], x["bytes"], x["sha256"]) for x in files], "path string, rows long, bytes long, sha256 string")


def field_report(spark: SparkSession, path: str):
    """(field, rows, present, finite, missing, zeros) of a written folder."""
    rows = json.loads(_read(path, MANIFEST))["report"]
    return spark.createDataFrame([tuple(r.values()) for r in rows], "field string, rows long, present long, finite long, missing long, zeros long")
