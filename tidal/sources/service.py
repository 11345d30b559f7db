"""Client of a heliophysics data service (capabilities, catalogue, info and CSV data), and file downloads.

The transport is a function (url, params) -> (status, body), so it needs no
particular HTTP library; data bodies are written to files, which Spark reads.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import year_chunks

Transport = Callable[[str, dict], tuple[int, str]]
#: Status codes worth another try, the service's own code for success, and the length of a body's preview.
TRANSIENT, SERVICE_OK, PREVIEW = (502, 503, 504), 1200, 1200


class ServiceError(RuntimeError):
    def __init__(self, message: str, status: int | None = None, url: str | None = None, body: str = ""):
        super().__init__(message)
        self.status, self.url, self.body = status, url, preview(body)


def preview(body: str) -> str:
    return body.strip().replace("\x00", "")[:PREVIEW]


def http_get(url: str, params: dict) -> tuple[int, str]:
    """The transport over the standard library."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    try:
        with urllib.request.urlopen(full, timeout=60) as r:
            return r.status, r.read().decode("utf-8", errors="replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", errors="replace")


@dataclass(frozen=True)
class DatasetInfo:
    id: str
    start: str | None
    stop: str | None
    parameters: list[dict]
    raw: dict


class Service:
    def __init__(self, base: str, transport: Transport = http_get, retries: int = 2, pause: float = 0.5):
        self.base, self.transport, self.retries, self.pause = base.rstrip("/"), transport, max(0, retries), pause
        self._major: int | None = None

    def get(self, endpoint: str, **params: str) -> str:
        """Body of a successful answer; network errors and transient codes are tried again with growing pauses."""
        url = f"{self.base}/{endpoint}"
        for attempt in range(self.retries + 1):
            last = attempt == self.retries
            try:
                status, body = self.transport(url, params)
            except OSError as e:
                if last:
                    raise ServiceError(f"network error at {url}: {e}", url=url) from e
            else:
                if status not in TRANSIENT or last:
                    if status >= 400:
                        raise ServiceError(f"HTTP {status} from {url}", status, url, body)
                    return body
            time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def json(self, endpoint: str, **params: str) -> dict:
        body = self.get(endpoint, **params)
        try:
            answer = json.loads(body)
        except ValueError as e:
            raise ServiceError(f"{endpoint} is not JSON", body=body) from e
        code = (answer.get("status") or {}).get("code", SERVICE_OK)
        if int(code) != SERVICE_OK:
            raise ServiceError(f"{endpoint}: status {code}", body=body)
        return answer

    def capabilities(self) -> dict:
        answer = self.json("capabilities")
        head = str(answer.get("HAPI", "")).split(".")[0]
        self._major = int(head) if head.isdigit() else None
        return answer

    def current_names(self) -> bool:
        """Whether the service takes the names of version 3 on; so assumed where it doesn't say."""
        if self._major is None:
            try:
                self.capabilities()
            except ServiceError:
                pass
            self._major = self._major or 3
        return self._major >= 3

    def _either(self, names: dict, old_names: dict) -> list[dict]:
        return [names, old_names] if self.current_names() else [old_names, names]

    def _first(self, call: Callable, candidates: list[dict]):
        for i, params in enumerate(candidates):
            try:
                return call(params)
            except ServiceError:
                if i == len(candidates) - 1:
                    raise

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(str(d.get("id")), d.get("title")) for d in self.json("catalog").get("catalog", [])]
        return spark.createDataFrame(rows, "id string, title string")

    def info(self, dataset: str) -> DatasetInfo:
        raw = self._first(lambda p: self.json("info", **p), self._either({"dataset": dataset}, {"id": dataset}))
        return DatasetInfo(dataset, raw.get("startDate"), raw.get("stopDate"), list(raw.get("parameters", [])), raw)

    def lines(self, dataset: str, start: str, stop: str, parameters: Iterable[str] = ()) -> list[str]:
        """The CSV lines of a period, comments left out."""
        names, old = {"dataset": dataset, "start": start, "stop": stop, "format": "csv"}, {"id": dataset, "time.min": start, "time.max": stop, "format": "csv"}
        if chosen := ",".join(parameters):
            names["parameters"] = old["parameters"] = chosen
        body = self._first(lambda p: self.get("data", **p), self._either(names, old))
        return [x for x in body.splitlines() if x.strip() and not x.startswith("#")]

    def data(self, spark: SparkSession, info: DatasetInfo, periods: Sequence[tuple[str, str]], folder: str, parameters: Iterable[str] = (), at_once: int = 4) -> DataFrame:
        """The data of some periods with the names of the metadata; all columns are text.

        Tasks fetch a period each, at_once of them at a time, and write its lines under folder, which all executors
        share; what is read comes from there, so that a lost executor's periods are fetched again and others aren't.
        """
        wanted = list(parameters)
        self.current_names()  # asked once, not by every task

        def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for period in batch.to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(self.lines(info.id, period["start"], period["stop"], wanted), type=pa.string())], names=["value"])

        spark.createDataFrame(list(periods), "start string, stop string").repartition(at_once).mapInArrow(fetch, "value string").write.mode("overwrite").text(folder)
        names = [str(p["name"]) for p in info.parameters]
        kept = [n for i, n in enumerate(names) if not wanted or n in wanted or i == 0]
        return spark.read.csv(folder, schema=", ".join(f"`{n}` string" for n in kept))

    def read_years(self, spark: SparkSession, info: DatasetInfo, start: str, stop: str, folder: str, parameters: Iterable[str] = ()) -> DataFrame:
        """The data of a period, fetched year by year."""
        return self.data(spark, info, year_chunks(start, stop), folder, parameters)


def save_info(info: DatasetInfo, path: str) -> None:
    Path(path).write_text(json.dumps(info.raw, indent=2))


def download(url: str, path: str, block: int = 1 << 20) -> str:
    """Streams a file to path in blocks."""
    with urllib.request.urlopen(url, timeout=60) as r, open(path, "wb") as f:
        while chunk := r.read(block):
            f.write(chunk)
    return path
