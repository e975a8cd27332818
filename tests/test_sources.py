"""Formats by round trips and small files of our own."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark import cli
from gridspark.model import Dataset
from gridspark.sources import binary, registry, text
from gridspark.streaming import events

GRID = np.arange(24.0).reshape(2, 3, 4)


@pytest.fixture(scope="module")
def ds(spark):
    a = Dataset.from_arrays(spark, {"o3": np.ma.masked_where(GRID == 5, GRID)}, {"o3": ("time", "lat", "lon")}, title="t")
    for d, values in (("lat", [10.0, 20.0, 30.0]), ("lon", [1.0, 2.0, 3.0, 4.0])):
        a = a.merge(Dataset.from_arrays(spark, {d: np.array(values)}, {d: (d,)}))
    return a.set_coords("lat", "lon")


def test_native_round_trip(spark, ds, tmp_path):
    registry.save(ds, f"file://{tmp_path}/d")
    back = registry.open_dataset(spark, f"file://{tmp_path}/d")
    assert back.dims == ds.dims and back.attrs == ds.attrs and back.coords == ds.coords
    assert np.ma.allequal(back.to_numpy("o3"), ds.to_numpy("o3")) and (back.to_numpy("o3").mask == (GRID == 5)).all()
    twice = registry.open_many(spark, [f"file://{tmp_path}/d"] * 2, "time")
    assert twice.dims["time"] == 4


def test_csv_round_trip(spark, ds, tmp_path):
    text.write_grid_csv(ds, f"file://{tmp_path}/c")
    back = text.read_grid_csv(spark, f"file://{tmp_path}/c/time_lat_lon", ("time__i", "lat", "lon"))
    assert np.ma.allequal(back.to_numpy("o3"), ds.to_numpy("o3"))


def test_icartt(spark, tmp_path):
    head = ["16, 1001", "Someone", "Somewhere", "An instrument", "A mission", "1, 1", "2004, 06, 26, 2005, 01, 12", "0", "Start_UTC, seconds", "2", "1, 0.5", "-9999, -9999", "OH, pptv", "HO2, pptv", "LLOD_FLAG: -8888", "Start_UTC, OH, HO2"]
    (tmp_path / "a.ict").write_text("\n".join([*head, "1, 2.5, 4", "2, -9999, 6", "3, 1, -9999"]) + "\n")
    got = registry.open_dataset(spark, f"file://{tmp_path}/a.ict")
    assert got.dims == {"POINTS": 3} and got.vars["OH"].attrs["units"] == "pptv" and got.attrs["LLOD_FLAG"] == "-8888"
    assert np.ma.allequal(got.to_numpy("OH"), np.ma.masked_values([2.5, -9999, 1], -9999)) and np.ma.allequal(got.to_numpy("HO2"), np.ma.masked_values([2, 3, -9999], -9999))


def test_profiles_and_grids(spark, tmp_path):
    (tmp_path / "p").write_text('a\nb\nc\n 2 2 1.0 0.5 0.0\n 1988180 00\n"O3" 1.0E-02 2.0E-02\n"SRFACC" 3.0 4.0\n')
    p = registry.open_dataset(spark, f"file://{tmp_path}/p", "icon_profile")
    assert p.attrs["VGLVLS"] == [1.0, 0.5, 0.0] and p.to_numpy("O3").tolist() == [0.01, 0.02] and p.vars["SRFACC"].attrs["units"] == "m**2/m**3"
    (tmp_path / "g").write_text("' '\n'LAM'\n 2 33.0 45.0 -97.0 -97.0 40.0\n' '\n'G1'\n'LAM' -1000.0 -2000.0 10.0 20.0 3 4 1\n' '\n")
    g = text.read_griddesc(spark, f"file://{tmp_path}/g")["G1"]
    assert (g["GDTYP"], g["NCOLS"], g["NROWS"], g["XCELL"]) == (2, 3, 4, 10.0)
    t = text.template(spark, g, layers=2, names=["O3"])
    assert t.dims == {"TSTEP": 1, "LAY": 2, "ROW": 4, "COL": 3} and t.frame("O3").count() == 24


def test_fixed_width_and_lines(spark, tmp_path):
    (tmp_path / "f").write_text("head\n  1 ab 2.5\n  2 cd\n")
    got = text.read_fixed(spark, f"file://{tmp_path}/f", {"n": (1, 3, "int"), "s": (5, 2, "string"), "x": (8, 4, "double")}, 1).orderBy("n").collect()
    assert [tuple(r) for r in got] == [(1, "ab", 2.5), (2, "cd", None)]


def test_aqs(spark, tmp_path):
    head = "State Code,County Code,Site Num,Parameter Name,Units of Measure,Latitude,Longitude,Date GMT,Time GMT,Sample Measurement\n"
    row = "01,003,0010,Ozone,ppm,30.5,-87.9,2020-07-01,{},{}\n"
    (tmp_path / "a.csv").write_text(head + row.format("05:00", 0.02) + row.format("05:00", 0.04) + row.format("06:00", 0.05))
    got = text.read_aqs(spark, f"file://{tmp_path}/a.csv", end="2020-07-01 05:30:00").collect()
    assert len(got) == 1 and abs(got[0].value - 0.03) < 1e-12 and got[0].site == "010030010"


def test_aqs_codes_longer_than_usual_stay_apart(spark, tmp_path):
    head = "State Code,County Code,Site Num,Parameter Name,Units of Measure,Latitude,Longitude,Date GMT,Time GMT,Sample Measurement\n"
    (tmp_path / "a.csv").write_text(head + "".join(f"{a},{b},{c},Ozone,ppb,1,2,2020-07-01,05:00,{v}\n" for a, b, c, v in ((1, 2, 10001, 1), (1, 2, 10002, 3), (1, 2, 1000, 5), (123, 4567, 7, 7))))
    got = {r["site"]: r["value"] for r in text.read_aqs(spark, f"file://{tmp_path}/a.csv").collect()}
    assert got == {"0100210001": 1, "0100210002": 3, "010021000": 5, "12345670007": 7}


def test_average_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    for k in range(2):
        a = binary.Average("AVERAGE", "made here", (0.0, 0.0, 4.0, 4.0), ["O3", "NO2"], [(2011001 + k, float(h), 2011001 + k, h + 1.0) for h in range(3)], rng.random((3, 2, 2, 3, 4)).astype("f4"))
        raw = binary.encode_average(a)
        b = binary.decode_average(raw)
        assert (b.values == a.values).all() and b.species == a.species and b.times == a.times and b.name == "AVERAGE" and binary.encode_average(b) == raw
        (tmp_path / f"{k}.avg").write_bytes(raw)
    got = binary.read_average(spark, f"file://{tmp_path}")
    assert got.count() == 2 * 3 * 2 * 2 * 3 * 4
    r = got.filter("date = 2011002 AND hour = 2 AND species = 'NO2' AND LAY__i = 1 AND ROW__i = 2 AND COL__i = 3").first()
    assert r.value == a.values[2, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        list(binary.records(raw[:-4] + b"\0\0\0\1"))


def test_layers(spark, tmp_path):
    planes = [(float(h), 2011001, np.full((2, 3), 100 * h + 10 * k + v)) for h in (0, 1) for k in range(2) for v in range(2)]
    (tmp_path / "zp").write_bytes(binary.encode_layers(planes))
    got = binary.read_layers(spark, f"file://{tmp_path}/zp", 2, 3, ["HGHT", "PRES"])
    r = {(x.hour, x.name, x.LAY__i): x.value for x in got.filter("ROW__i = 0 AND COL__i = 0").collect()}
    assert r == {(float(h), n, k): 100.0 * h + 10 * k + v for h in (0, 1) for k in range(2) for v, n in enumerate(["HGHT", "PRES"])}


@given(st.integers(2, 9), st.integers(2, 9), st.integers(0, 99))
@settings(max_examples=30, deadline=None)
def test_packed_planes(ny, nx, seed):
    a = np.cumsum(np.random.default_rng(seed).normal(size=(ny, nx)), axis=1)
    raw, exponent, first = binary.pack_bytes(a)
    assert np.abs(binary.unpack_bytes(raw, ny, nx, exponent, first) - a).max() <= 2.0 ** (exponent - 7)


def test_netcdf(spark, tmp_path):
    v = {"o3": (("t", "x"), {"units": "ppb", "_FillValue": -999.0}, np.array([[1.5, -999.0, 3.0], [4.0, 5.0, 6.0]])), "n": ((), {}, np.array(7, dtype="i4"))}
    raw = binary.encode_netcdf({"t": 2, "x": 3}, v, {"title": "héllo", "level": 3, "edges": [0.5, 1.5]})
    dims, found, attrs = binary.decode_netcdf(raw)
    assert dims == {"t": 2, "x": 3} and attrs == {"title": "héllo", "level": 3, "edges": [0.5, 1.5]} and (found["o3"][2] == v["o3"][2]).all() and found["n"][2] == 7
    (tmp_path / "a.nc").write_bytes(raw)
    got = {(r.t__i, r.x__i): r.o3 for r in binary.read_netcdf(spark, f"file://{tmp_path}/a.nc", "o3").collect()}
    assert got[0, 0] == 1.5 and got[0, 1] is None and got[1, 2] == 6.0


def test_command_line(spark, ds, tmp_path, capsys):
    registry.save(ds, f"file://{tmp_path}/d")
    out = cli.run(spark, ["gen", f"file://{tmp_path}/d", "-o", f"file://{tmp_path}/e", "-v", "o3", "-s", "lat,0,2", "-r", "time,mean", "--expr", "d = o3 * 2"])
    assert np.allclose(out.to_numpy("d"), 2 * np.ma.masked_where(GRID == 5, GRID).mean(axis=0)[None, :2])
    assert registry.open_dataset(spark, f"file://{tmp_path}/e").dims["lat"] == 2
    cli.run(spark, ["dump", f"file://{tmp_path}/d"])
    assert "o3(time, lat, lon)" in capsys.readouterr().out
    rows = cli.run(spark, ["eval", f"file://{tmp_path}/d", f"file://{tmp_path}/d", "--funcs", "MB,NOP"])
    assert rows == [("o3", "MB", 0.0), ("o3", "NOP", 23)]


def test_stream_equals_table(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"file://{tmp_path}/in")
    q = events.window_means(stream, "ts", "value", ["event_type"], late="60 days").writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.start, r.event_type, round(r.mean, 6), r.n) for r in df.collect())
    assert key(spark.table("means")) == key(events.window_means(src, "ts", "value", ["event_type"]))
    assert events.sessions(src, "ts", ["user_id"]).agg(F.sum("n")).first()[0] == src.count()
