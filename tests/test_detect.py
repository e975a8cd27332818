"""What files hold, found from their bytes; netCDF by slabs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.sources import binary, netcdf, records, registry
from gridspark.sources.binary import record


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("mixed")
    rng = np.random.default_rng(0)
    v = rng.random((3, 1, 2, 4, 5)).astype("f4")
    (d / "a").write_bytes(binary.encode_average(binary.Average("AVERAGE", "", (0.0, 0.0, 1.0, 1.0), ["O3"], [(2011001, float(h), 2011001, h + 1.0) for h in range(3)], v)))
    a = rng.random((6, 4)).astype("f4")
    a[2, 1] = -9
    (d / "b").write_bytes(binary.encode_netcdf({"t": 6, "x": 4}, {"o3": (("t", "x"), {"_FillValue": -9.0}, a), "x": (("x",), {}, np.arange(4.0)), "n": ((), {}, np.array(7))}, {"title": "here", "long": "z" * 70_000}))
    plane = struct.pack(">fi", 0.0, 2005185) + rng.random((4, 5)).astype(">f4").tobytes()
    (d / "c").write_bytes(record(plane) * 4)
    (d / "d").write_bytes(b"".join([record(struct.pack(">fi", 0.0, 2005185)), record(plane[8:]), record(plane[8:]), record(b"\0" * 4)]))
    (d / "e").write_bytes(b"time,layer,v\n0,1,2.5\n0,2,3.5\n")
    (d / "f").write_bytes(b"36, 1001\nnames\n")
    (d / "g").write_bytes(bytes(range(200)) * 3)
    (d / "h").write_bytes(record(b"LUCAT11 ") + record(b"\0" * 4 * 11 * 20))
    (d / "i").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    (d / "j").write_bytes(b"")
    (d / "k").write_bytes(record(b"x" * 20 + struct.pack(">iii", 5, 4, 1)) + record(struct.pack(">fi", 0.0, 2005185)) + record(plane[8:]) * 5)
    return d, v, a


def test_formats(spark, folder):
    got = {r["path"][-1]: r["format"] for r in records.detect_all(spark, f"file://{folder[0]}").collect()}
    assert got == {"a": "average", "b": "netcdf", "c": "timed", "d": "wind", "e": "csv", "f": "ffi1001", "g": None, "h": "landuse", "i": "hdf5", "j": None, "k": "cloud_rain"}


def test_opened_without_a_name(spark, folder):
    d, v, a = folder
    ds = registry.open_dataset(spark, f"file://{d}/a")
    assert ds.dims == {"TSTEP": 3, "LAY": 2, "ROW": 4, "COL": 5} and (ds.to_numpy("O3").astype("f4") == v[:, 0]).all()
    nc = registry.open_dataset(spark, f"file://{d}/b")
    assert nc.dims == {"t": 6, "x": 4} and nc.coords == {"x"} and nc.attrs["title"] == "here" and nc.frame("n").first()["n"] == 7
    got = nc.to_numpy("o3")
    assert got.mask.sum() == 1 and got.mask[2, 1] and np.ma.allclose(got, np.ma.masked_equal(a, -9))
    with pytest.raises(ValueError, match="hdf5"):
        registry.open_dataset(spark, f"file://{d}/i")
    clouds = registry.open_dataset(spark, f"file://{d}/k")
    assert set(clouds.vars) == {"CLOUD", "RAIN", "SNOW", "GRAUPEL", "COD"} and clouds.dims["TSTEP"] == 1


def test_mixed(spark, folder, tmp_path):
    import shutil

    for x in "abgk":
        shutil.copy(folder[0] / x, tmp_path / x)
    found = registry.open_mixed(spark, f"file://{tmp_path}")
    assert {k: len(v) for k, v in found.items()} == {"average": 1, "netcdf": 1, "cloud_rain": 1}
    assert found["average"][0].frame("O3").count() == 3 * 2 * 4 * 5


def test_netcdf_slabs(spark, folder):
    path = f"file://{folder[0]}/b"
    df = netcdf.read_variable(spark, path, "o3", slab=40)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 24
    some = df.filter("t__i >= 4 AND x__i = 2")
    assert [(r["t__i"], r["x__i"]) for r in some.orderBy("t__i").collect()] == [(4, 2), (5, 2)] and some.rdd.getNumPartitions() == 1
    assert df.filter(F.col("o3").isNull()).count() == 1
    f = records.File(path)
    netcdf.header(f)
    assert f.n_read < 5 * 70_000


def test_netcdf_records(spark, tmp_path):
    """Two variables with records lie interleaved, padded to four bytes."""
    i4 = lambda *x: struct.pack(f">{len(x)}i", *x)
    name = lambda s: i4(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF\1" + i4(3) + i4(10, 2) + name("t") + i4(0) + name("x") + i4(3) + i4(0, 0) + i4(11, 2)
    entry = lambda n, kind, size, at: name(n) + i4(2, 0, 1) + i4(0, 0) + i4(kind, size, at)
    start = len(head) + len(entry("a", 3, 8, 0)) + len(entry("b", 5, 12, 0))
    head += entry("a", 3, 8, start) + entry("b", 5, 12, start + 8)
    body = b"".join(struct.pack(">3h2x3f", t, t + 10, t + 20, t + 0.5, t + 1.5, t + 2.5) for t in range(3))
    (tmp_path / "r.nc").write_bytes(head + body)
    a = netcdf.read_variable(spark, f"file://{tmp_path}/r.nc", "a", slab=6)
    assert sorted((r["t__i"], r["x__i"], r["a"]) for r in a.collect()) == [(t, x, t + 10.0 * x) for t in range(3) for x in range(3)]
    b = netcdf.open_netcdf(spark, f"file://{tmp_path}/r.nc").to_numpy("b")
    assert b.tolist() == [[t + 0.5 + x for x in range(3)] for t in range(3)]
