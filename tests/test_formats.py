"""The service as a format, the committing sink, downloads by tasks and the phase store."""

import hashlib
import http.server
import json
import threading
import urllib.parse
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidal.sources import downloads, formats
from tidal.sources.phase_store import PhaseStore


class Handler(http.server.BaseHTTPRequestHandler):
    """A service of version 3 with one data set, and files that it sends in ranges."""

    def do_HEAD(self):  # noqa: N802
        self._answer(b"", {"Content-Length": str(len(self.server.files[self.path]))})

    def do_GET(self):  # noqa: N802
        at = urllib.parse.urlsplit(self.path)
        asked = dict(urllib.parse.parse_qsl(at.query))
        if at.path in self.server.files:
            first, last = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            self.server.ranges.append(first)
            if first in self.server.broken:
                return self._answer(b"", {}, 503)
            return self._answer(self.server.files[at.path][first : last + 1], {}, 206)
        if at.path.endswith("capabilities"):
            return self._answer(b'{"HAPI": "3.0", "status": {"code": 1200}}')
        if at.path.endswith("info"):
            fields = [{"name": "Time", "type": "isotime"}, {"name": "V", "type": "double", "fill": "-1.0"}, {"name": "B", "type": "double", "size": [3]}, {"name": "N", "type": "integer"}, {"name": "S", "type": "string"}]
            return self._answer(json.dumps({"startDate": "1979-05-01", "stopDate": "1982-02-03", "parameters": fields, "status": {"code": 1200}}).encode())
        self.server.asked.append((asked["start"], asked["stop"], asked.get("parameters")))
        lines = [f"{asked['start']}T00:00Z,{i},1,2,{i},{i},x" if "parameters" not in asked else f"{asked['start']}T00:00Z,{i}" for i in (-1, 5)]
        self._answer(("# note\n" + "\n".join(lines)).encode())

    def _answer(self, body, headers=None, status=200):
        self.send_response(status)
        for k, v in ({"Content-Length": str(len(body))} | (headers or {})).items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.files, s.ranges, s.broken, s.asked = {}, [], set(), []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url = f"http://127.0.0.1:{s.server_port}"
    yield s
    s.shutdown()


def test_service_format(spark, server):
    formats.register(spark)
    rows = spark.read.format("measurement_service").options(url=server.url, dataset="d", pause="0").load()
    assert dict(rows.dtypes) == {"Time": "timestamp", "V": "double", "B": "array<double>", "N": "bigint", "S": "string"}
    got = rows.orderBy("Time", "N").collect()
    assert [r["Time"].date() for r in got] == [date(1979, 5, 1)] * 2 + [date(1980, 1, 1)] * 2 + [date(1981, 1, 1)] * 2 + [date(1982, 1, 1)] * 2
    assert [tuple(r)[1:] for r in got[:2]] == [(None, [1.0, 2.0, -1.0], -1, "x"), (5.0, [1.0, 2.0, 5.0], 5, "x")]
    assert {a[:2] for a in server.asked} == {("1979-05-01", "1980-01-01"), ("1980-01-01", "1981-01-01"), ("1981-01-01", "1982-01-01"), ("1982-01-01", "1982-02-04")}


def test_bounds_and_columns_reach_the_service(spark, server):
    formats.register(spark)
    rows = spark.read.format("measurement_service").options(url=server.url, dataset="d", parameters="V", pause="0").load()
    assert rows.columns == ["Time", "V"]
    cut = rows.where((F.col("Time") >= F.lit("1980-03-01").cast("timestamp")) & (F.col("Time") < F.lit("1981-02-01").cast("timestamp")))
    assert cut.rdd.getNumPartitions() == 2
    assert sorted(r["Time"].date() for r in cut.collect()) == [date(1980, 3, 1)] * 2 + [date(1981, 1, 1)] * 2
    assert {(a, b) for a, b, _ in server.asked} == {("1980-03-01", "1981-01-01"), ("1981-01-01", "1981-02-02")} and {p for *_, p in server.asked} == {"V"}
    assert rows.where(F.col("Time") > F.lit("1990-01-01").cast("timestamp")).count() == 0


@pytest.mark.parametrize("text, want", [("1980-061T12:30Z", (1980, 3, 1, 12, 30)), ("1980-03-01", (1980, 3, 1, 0, 0)), ("1980-03-01T01:02:03.5Z", (1980, 3, 1, 1, 2, 3, 500000)), ("no", None), ("1980-03-01Tx", None)])
def test_moments(text, want):
    assert formats.moment(text) == (datetime(*want, tzinfo=timezone.utc) if want else None)


RECORDS = "d date, v double, n long, s string, b boolean"


def records(spark, n=50):
    rows = [(date(1980, 1, 1 + i % 28), None if i % 7 == 0 else float("nan") if i % 11 == 0 else i / 3, i % 5, [None, "", '""', 'a,"b"\nc', "é"][i % 5], bool(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, RECORDS)


def test_sink_round_trip(spark, tmp_path):
    formats.register(spark)
    path, rows = str(tmp_path / "out"), records(spark).repartition(4)
    rows.write.format("measurement_records").mode("overwrite").save(path)
    back = spark.read.format("measurement_records").option("path", path).load()
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    files = formats.manifest(spark, path).collect()
    assert len(files) == 4 and sum(f["rows"] for f in files) == 50
    for f in files:
        data = (tmp_path / "out" / f["path"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (f["bytes"], f["sha256"])
    report = {r["field"]: tuple(r)[1:] for r in formats.field_report(spark, path).collect()}
    assert report["v"] == (50, 42, 38, 12, 0) and report["s"] == (50, 40, 40, 10, 0) and report["n"] == (50, 50, 50, 0, 10)
    rows.write.format("measurement_records").mode("append").save(path)
    assert spark.read.format("measurement_records").option("path", path).load().count() == 100
    records(spark, 3).write.format("measurement_records").mode("overwrite").save(path)
    assert spark.read.format("measurement_records").option("path", path).load().count() == 3
    records(spark, 0).write.format("measurement_records").mode("overwrite").save(path)
    assert spark.read.format("measurement_records").option("path", path).load().count() == 0


def test_a_failed_task_leaves_nothing_readable(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "out")
    bad = records(spark).repartition(4).withColumn("n", F.when(F.col("n") == 3, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("measurement_records").mode("overwrite").save(path)
    assert not (tmp_path / "out" / formats.MANIFEST).exists() and not list((tmp_path / "out").glob("*/*"))
    records(spark).write.format("measurement_records").mode("overwrite").save(path)
    with pytest.raises(Exception, match="stop"):
        bad.write.format("measurement_records").mode("append").save(path)
    assert spark.read.format("measurement_records").option("path", path).load().count() == 50


def test_changed_files_are_refused(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "out")
    records(spark).coalesce(1).write.format("measurement_records").mode("overwrite").save(path)
    next((tmp_path / "out").glob("*/part-*")).write_text("x")
    with pytest.raises(Exception, match="manifest says"):
        spark.read.format("measurement_records").option("path", path).load().count()


def test_downloads_resume(spark, server, tmp_path):
    data = bytes(range(256)) * 40
    server.files.update({"/a": data, "/b": b"small", "/empty": b""})
    files = [(f"{server.url}{n}", str(tmp_path / n[1:])) for n in server.files]
    server.broken.add(6000)
    with pytest.raises(Exception, match="503"):
        downloads.download(spark, files, part_bytes=1000)
    assert not (tmp_path / "a").exists() and len(list((tmp_path / "a.parts").glob("*.sha256"))) >= 1
    fetched = {int(p.name.split(".")[0]) for p in (tmp_path / "a.parts").glob("*.sha256")}
    server.broken.clear()
    server.ranges.clear()
    got = {r["path"]: (r["bytes"], r["sha256"]) for r in downloads.download(spark, files, part_bytes=1000).collect()}
    assert got == {str(tmp_path / n[1:]): (len(d), hashlib.sha256(d).hexdigest()) for n, d in server.files.items()}
    assert (tmp_path / "a").read_bytes() == data and (tmp_path / "empty").read_bytes() == b"" and not list(tmp_path.glob("*.parts"))
    assert not set(server.ranges) - {0} & fetched - {0}
    assert {tuple(r)[1:] for r in downloads.digests(spark, f"{tmp_path}/[ab]").collect()} == {got[str(tmp_path / n)] for n in "ab"}


def test_short_answers_and_changed_parts_fail(tmp_path):
    system, folder = downloads._place(str(tmp_path))
    with pytest.raises(OSError, match="3 bytes of 10"):
        downloads._fetch_part(system, folder, "u", 0, 10, lambda url, a, b: [b"abc"])
    assert not list(tmp_path.glob("*.sha256"))
    downloads._fetch_part(system, folder, "u", 0, 3, lambda url, a, b: [b"abc"])
    assert downloads._join(system, folder, f"{folder}/whole", [0]) == (3, hashlib.sha256(b"abc").hexdigest())
    (tmp_path / f"{0:020d}").write_bytes(b"abd")
    with pytest.raises(OSError, match="isn't what was fetched"):
        downloads._join(system, folder, f"{folder}/whole", [0])


TESTS = "channel string, band string, variant string, branch string, observed double, p double, p_holm double, q_bh double"


def test_phase_store(spark, tmp_path):
    store = PhaseStore(spark, str(tmp_path))
    rows = [(c, b, v, r, 0.5, None if c == "y" else 0.01, 0.02, 0.03) for c in "xy" for b in ("annual", "long") for v in ("raw", "detrended") for r in ("acf_a", "ccf")]
    tests = spark.createDataFrame(rows, TESTS)
    first = store.write("tests", tests, {"simulations": 9})
    second = store.write("review", tests.where("channel = 'x'"), parents=[first])
    assert sorted(map(str, store.read(first).collect())) == sorted(map(str, tests.collect())) and store.read(second).count() == 8
    document = json.loads(spark.read.text(f"{tmp_path}/{second}/documents").first()[0])
    assert document["tests"]["long"]["raw"]["ccf"]["p"] == 0.01
    assert store.lineage(second) == [second, first] and store.runs("tests") == [first] and store.manifest(first)["settings"] == {"simulations": 9}
    found = store.lookup(second, spark.createDataFrame([("x", "long", "raw", "ccf"), ("z", "long", "raw", "ccf")], "channel string, band string, variant string, branch string"))
    assert {(r["channel"], r["p_holm"]) for r in found.collect()} == {("x", 0.02), ("z", None)}
    with pytest.raises(KeyError):
        store.write("review", tests, parents=["tests-none"])
    (tmp_path / first / "manifest.json").unlink()  # as if that run had not finished
    with pytest.raises(KeyError):
        store.lineage(second)
    with pytest.raises(Exception):
        store._create(second, {})
