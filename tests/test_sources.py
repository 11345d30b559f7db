"""Archive layouts, mapping, the service client and sinks on generated inputs."""

import hashlib
import json
from datetime import date

import pytest

from tidal.sources import acquire, catalogue, mapping, service, sinks, text


def lines(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1)


def record(*head, n=12, extra=()):
    return " ".join(str(x) for x in (*head, *[f"{i}.5D-1" for i in range(n)], *extra))


def test_year_day_hour(spark):
    rows = ["HEADER of text"] + [record(72, 63 + i % 2, 0) for i in range(12)]
    got, info = text.daily_records(lines(spark, rows))
    assert info["layout"] == "year_doy_hour_particles" and info["rows_after_date_deduplication"] == 2 and info["modal_records"] == 12
    first = got.orderBy("date").first()
    assert first["date"] == date(1972, 3, 3) and first["he_11_20_mev_n"] == pytest.approx(0.15)


@pytest.mark.parametrize(
    "head, extra, layout, last",
    [((72, 63), (1, 2, 3), "year_doy", "z_au"), ((10, 72, 63), (1, 2, 3), "scid_year_doy", "z_au"), ((72.1721,), (1, 2, 3, 400), "decimal_year", "solar_wind_speed_km_s")],
)
def test_other_layouts(spark, head, extra, layout, last):
    rows = [record(*head[:-1], head[-1] + (i if layout != "decimal_year" else i / 365), extra=extra) for i in range(12)]
    got, info = text.daily_records(lines(spark, rows))
    assert info["layout"] == layout and got.count() == 12 and got.columns[-1] == last


def test_unknown_layout_fails(spark):
    with pytest.raises(text.LayoutError):
        text.daily_records(lines(spark, ["1 2 3 4 5"] * 12))
    with pytest.raises(text.LayoutError):
        text.daily_records(lines(spark, ["none"]))


def test_fixed_records_round_trip(spark, tmp_path):
    rows = text.fixed_records(lines(spark, ["# comment", record(72.1721, extra=(1, 2, 3, 400)).replace("D", "E")]))
    assert rows.first()["date"] == date(1972, 3, 3)
    sinks.write_fixed(rows, str(tmp_path / "out"))
    again = text.read_auto(spark, str(tmp_path / "out"), "x.dat").first()
    assert again["solar_wind_speed_km_s"] == 400 and again["time_decimal_year"] == pytest.approx(72.1721)
    with pytest.raises(Exception, match="expected 17"):
        text.fixed_records(lines(spark, ["1 2 3"])).collect()


def test_csv_aliases_and_dates(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# note\nYEAR,DOY,RID2P,VSW\n1980,60,1.5,400\n1981,366,2,1\n")
    rows = text.read_auto(spark, str(tmp_path / "a.csv")).orderBy("YEAR").collect()
    assert rows[0]["date"] == date(1980, 2, 29) and rows[0]["p_11_20_mev"] == "1.5" and rows[1]["date"] is None


def test_manifest(spark):
    got = text.collection_manifest(lines(spark, ["P, urn:a::1.0", "urn:b", ""])).collect()
    assert [(r["status"], r["lidvid"]) for r in got] == [("P", "urn:a::1.0"), (None, "urn:b")]


def test_year_chunks():
    assert text.year_chunks("1979-05-01", "1981-02-03") == [("1979-05-01", "1979-12-31"), ("1980-01-01", "1980-12-31"), ("1981-01-01", "1981-02-03")]


def test_mapping():
    fields = [{"name": "Time", "type": "isotime"}, *({"name": a} for a in catalogue.ALIASES if a not in ("SW_SPEED", "SOLAR_WIND_SPEED"))]
    names = [f["name"] for f in fields]
    assert mapping.time_column(names, fields) == "Time"
    assert mapping.channels(names, fields) == {c: a for a, c in catalogue.ALIASES.items() if c in catalogue.CHANNELS}
    assert mapping.coordinates(["X", "Y", "Z"]) == {"x_au": "X", "y_au": "Y", "z_au": "Z"}
    assert mapping.bulk_speed(["V", "N"], [{"name": "V", "units": "km/s", "description": "bulk speed"}, {"name": "N", "description": "density"}]) == "V"
    with pytest.raises(mapping.AmbiguousField):
        mapping.bulk_speed(["VSW", "vsw"])
    with pytest.raises(ValueError):
        mapping.bulk_speed(["N"])


def test_mapping_by_description():
    said = {
        "c1": "Protons 11-20 MeV", "c2": "helium, 20 to 24 MeV/n", "c3": "Electron flux 7-17 MeV", "c4": "ions > 67 MeV/n", "c5": "Ions Z>5, above 67 MeV/n",
        "c6": "minimum ionizing particles x2", "c7": "protons 29 - 67 MeV", "c8": "temperature",
    }
    fields = [{"name": n, "description": d} for n, d in said.items()]
    assert mapping.channels(list(said), fields) == {
        "p_11_20_mev": "c1", "he_20_24_mev_n": "c2", "e_7_17_mev": "c3", "ions_gt67_mev_n": "c4", "ions_zgt5_gt67_mev_n": "c5", "minimum_ionizing_x2": "c6", "p_29_67_mev": "c7",
    }
    assert mapping.channels(list(catalogue.CHANNELS)) == {c: c for c in catalogue.CHANNELS}
    with pytest.raises(mapping.AmbiguousField):
        mapping.channels(["a", "b"], [{"name": n, "description": "protons 11-20 MeV"} for n in "ab"])
    axes = [{"name": f"u{a}", "units": "AU", "description": f"heliocentric ecliptic Cartesian {a}"} for a in "XYZ"]
    assert mapping.coordinates([f["name"] for f in axes], axes) == {"x_au": "uX", "y_au": "uY", "z_au": "uZ"}
    speed = [{"name": "V", "units": "km/s", "description": "solar wind bulk velocity"}, {"name": "W", "units": "km/s", "size": [3], "description": "bulk velocity"}, {"name": "N", "units": "#/cc", "description": "number density"}]
    assert mapping.bulk_speed(["V", "W", "N"], speed) == "V"
    for unit in ("km/s", "km s-1", "km s^-1", "km/sec", "KM per second"):
        assert mapping.bulk_speed(["V"], [speed[0] | {"units": unit}]) == "V"
    for other in ({"units": "km"}, {"units": "nT"}, {"description": "proton speed"}, {"units": None}):
        with pytest.raises(ValueError):
            mapping.bulk_speed(["V"], [speed[0] | other])


def test_axes_stand_alone_in_names():
    assert mapping.coordinates(["X_AU", "posY", "HCI_Z"]) == {"x_au": "X_AU", "y_au": "posY", "z_au": "HCI_Z"}
    assert mapping.coordinates(["Bx", "HEX", "xyz", "x2y"], [{"name": "Bx", "units": "nT"}]) == {}
    with pytest.raises(mapping.AmbiguousField):
        mapping.coordinates(["a_X", "b_X"])
    assert mapping.coordinates(["a_X", "b_X"], [{"name": "a_X", "units": "km"}, {"name": "b_X", "units": "AU"}]) == {"x_au": "b_X"}
    assert mapping.time_column(["a", "t"], [{"name": "t", "type": "isotime"}]) == "t" and mapping.time_column(["a", "t"]) == "a"


@pytest.mark.parametrize("version, first", [("3.0", "dataset"), ("2.0", "id")])
def test_service(spark, tmp_path, version, first):
    seen = []

    def transport(url, params):
        end = url.rsplit("/", 1)[1]
        seen.append((end, tuple(params)))
        if end == "capabilities":
            return 200, json.dumps({"HAPI": version, "status": {"code": 1200}})
        if end == "info":
            return (500, "no") if first not in params else (200, json.dumps({"parameters": [{"name": "Time"}, {"name": "V"}], "status": {"code": 1200}}))
        return 200, f"# c\n{params.get('start') or params.get('time.min')},1\n"

    client = service.Service("http://x/", transport, pause=0)
    info = client.info("d")
    got = client.read_years(spark, info, "1979-05-01", "1980-02-03", str(tmp_path / "years"))
    assert sorted(r["Time"] for r in got.collect()) == ["1979-05-01", "1980-01-01"] and seen[1] == ("info", (first,))


def test_service_errors():
    calls = []

    def flaky(url, params):
        calls.append(url)
        return (503, "busy") if len(calls) < 3 else (500, "bad\x00")

    with pytest.raises(service.ServiceError) as e:
        service.Service("http://x", flaky, retries=5, pause=0).get("data")
    assert len(calls) == 3 and e.value.status == 500 and e.value.body == "bad"


def test_digest_and_documents(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert sinks.digests(spark, str(tmp_path / "f")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    got = sinks.as_documents(spark.createDataFrame([(1, "a", None)], "k int, v string, w double"), ["k"]).first()
    assert json.loads(got["document"]) == {"v": "a", "w": None}


def stand_in():
    """A service of version 3 with a daily data set of 12 channels, two lines a day, and an hourly speed."""

    def transport(url, params):
        end, hourly = url.rsplit("/", 1)[1], params.get("dataset") == "wind"
        if end == "capabilities":
            return 200, '{"HAPI": "3.0", "status": {"code": 1200}}'
        if end == "info":
            names = ["Time", "V"] if hourly else ["Time", *catalogue.CHANNELS, "X", "Y", "Z"]
            fields = [{"name": n, "units": "km/s", "description": "bulk speed"} if n == "V" else {"name": n} for n in names]
            return 200, json.dumps({"parameters": fields, "status": {"code": 1200}})
        day = params["start"]
        rows = [f"{day}T0{h}:00Z,{v}" for h, v in enumerate((400, -1, 450))] if hourly else [f"{day}T0{h}:00Z," + ",".join(str(i + h) for i in range(15)) for h in (0, 2)]
        return 200, "# note\n" + "\n".join(rows)

    return transport


def test_assembly_from_archive(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(record(72, 63 + i, extra=(1, 2, 3, 400)) for i in range(12)))
    paths = acquire.assemble(spark, acquire.Source("s", archive=str(tmp_path / "a.txt")), str(tmp_path / "out"))
    again = text.read_auto(spark, paths["fixed"], "x.dat")
    assert again.count() == 12 and again.agg({"date": "min"}).first()[0] == date(1972, 3, 3) and again.first()["solar_wind_speed_km_s"] == 400
    rows = spark.read.json(paths["report"]).collect()
    assert {r["field"] for r in rows} == set(catalogue.RECORD[1:]) and all(r["finite"] == 12 and r["complete"] and not r["matches_reference"] for r in rows)
    for r in spark.read.json(paths["digests"]).collect():
        assert r["sha256"] == hashlib.sha256(open(r["path"].removeprefix("file:"), "rb").read()).hexdigest()


def test_assembly_falls_back_to_the_service(spark, tmp_path):
    (tmp_path / "a.txt").write_text("no numbers")
    client = service.Service("http://x", stand_in(), pause=0)
    source = acquire.Source("s", str(tmp_path / "a.txt"), "daily", "1979-05-01", "1980-02-03")
    paths = acquire.assemble(spark, source, str(tmp_path / "core"), client)
    assert "records" not in paths and sorted(r["p_11_20_mev"] for r in spark.read.csv(paths["daily"], header=True).collect()) == ["1.0", "1.0"]
    assert "LayoutError" in spark.read.json(paths["notes"]).first()["notes"]
    info = client.info("wind")
    speed, _ = acquire.hourly_speed(client.read_years(spark, info, "1979-05-01", "1980-02-03", str(tmp_path / "wind")), info.parameters)
    paths = acquire.assemble(spark, source, str(tmp_path / "full"), client, speed)
    got = sorted(spark.read.csv(paths["records"], header=True, inferSchema=True).collect())
    assert [(str(r["date"]), r["solar_wind_speed_km_s"], r["x_au"]) for r in got] == [("1979-05-01", 425, 13), ("1980-01-01", 425, 13)] and got[0]["time_decimal_year"] == pytest.approx(79 + 121 / 365)


def test_acquisition_fails_with_all_faults(spark, tmp_path):
    client = service.Service("http://x", lambda url, params: (500, "no"), retries=0, pause=0)
    with pytest.raises(acquire.AcquisitionError, match="archive: .*service: ServiceError"):
        acquire.acquire(spark, acquire.Source("s", str(tmp_path / "none"), "d", "1980-01-01", "1980-02-03"), client, str(tmp_path))


def test_iso_dates_in_any_time_zone(spark):
    rows = spark.createDataFrame([("1980-03-01T23:59Z",), ("1980-061T00:00Z",), ("x",)], "t string")
    got = [str(r[0]) for r in rows.select(acquire.utc_date(rows.t)).collect()]
    assert got == ["1980-03-01", "1980-03-01", "None"]
