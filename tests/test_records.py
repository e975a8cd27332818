"""Files of records: planned by bytes, read by slabs, filtered before reading, written by tasks."""

import struct

import numpy as np
import pytest

from gridspark.sources import binary, records
from gridspark.sources.binary import record

NT, NS, NZ, NY, NX = 7, 2, 3, 4, 5


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(4).random((NT, NS, NZ, NY, NX)).astype("f4")


@pytest.fixture(scope="module")
def average(tmp_path_factory, values):
    path = tmp_path_factory.mktemp("avg") / "one"
    times = [(2011001, float(h), 2011001, h + 1.0) for h in range(NT)]
    path.write_bytes(binary.encode_average(binary.Average("AVERAGE", "made here", (0.0, 0.0, 4.0, 4.0), ["O3", "NO2"], times, values)))
    return f"file://{path}"


def _rows(df):
    return sorted((r["step"], r["name"], r["LAY__i"], r["ROW__i"], r["COL__i"], r["value"]) for r in df.collect())


def _all(values):
    return sorted((t, ("O3", "NO2")[s], k, j, i, float(values[t, s, k, j, i])) for t, s, k, j, i in np.ndindex(values.shape))


@pytest.mark.parametrize("slab", [100, 500, 999, 1 << 20])
def test_one_file_many_tasks(spark, average, values, slab):
    df = records.read_records(spark, average, slab=slab)
    size = records.File(average).size
    assert df.rdd.getNumPartitions() == -(-size // slab)
    assert _rows(df) == _all(values)
    assert {(r["date"], r["hour"]) for r in df.select("date", "hour").distinct().collect()} == {(2011001, float(h)) for h in range(NT)}


def test_filters_reach_the_file(spark, average, values):
    df = records.read_records(spark, average, slab=700)
    cond = "name = 'NO2' AND step >= 2 AND step < 5 AND LAY__i = 1 AND ROW__i BETWEEN 1 AND 2 AND COL__i > 2"
    got = df.filter(cond)
    assert _rows(got) == [r for r in _all(values) if r[1] == "NO2" and 2 <= r[0] < 5 and r[2] == 1 and 1 <= r[3] <= 2 and r[4] > 2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan or "NO2" not in plan.split("BatchScan")[0]
    assert _rows(df.filter("value > 0.9 AND name IN ('O3', 'X')")) == [r for r in _all(values) if r[5] > 0.9 and r[1] == "O3"]
    assert df.filter("LAY__i > 7").count() == 0 and df.filter("name = 'none'").count() == 0


def test_fewer_bytes(average):
    def n_read(wanted):
        f = records.File(average)
        layout = records.average(f)
        list(records.slabs(f, layout, 0, f.size, wanted))
        return f.n_read

    whole = n_read(records.Wanted())
    few = n_read(records.Wanted(low={"step": 3}, high={"step": 3}))
    assert whole > NT * NS * NZ * NY * NX * 4 and few < whole / 3
    records_gap, records.GAP = records.GAP, 0
    try:
        rows = n_read(records.Wanted({"O3"}, {"LAY__i": 1, "ROW__i": 2}, {"LAY__i": 1, "ROW__i": 2}))
    finally:
        records.GAP = records_gap
    assert rows < whole / 5


def test_other_layouts(spark, tmp_path):
    rng = np.random.default_rng(1)
    plane = lambda: rng.random((NY, NX)).astype(">f4")
    surface, layers = [plane() for _ in range(2)], [[[plane() for _ in range(5)] for _ in range(NZ)] for _ in range(2)]
    stamp = lambda t: struct.pack(">fi", 100.0 * t, 2005185)
    write = lambda name, parts: (tmp_path / name).write_bytes(b"".join(parts))
    write("temperature", [record(stamp(t) + p.tobytes()) for t in range(2) for p in [surface[t], *(layers[t][k][0] for k in range(NZ))]])
    write("height_pressure", [record(stamp(t) + layers[t][k][v].tobytes()) for t in range(2) for k in range(NZ) for v in range(2)])
    write("humidity", [record(stamp(t) + layers[t][k][0].tobytes()) for t in range(2) for k in range(NZ)])
    write("wind", [x for t in range(2) for x in [record(stamp(t) + struct.pack(">i", 1)), *(record(layers[t][k][v].tobytes()) for k in range(NZ) for v in range(2)), record(b"\0" * 4)]])
    write("cloud5", [record(b"x" * 20 + struct.pack(">iii", NX, NY, NZ))] + [x for t in range(2) for x in [record(stamp(t)), *(record(layers[t][k][v].tobytes()) for k in range(NZ) for v in range(5))]])
    write("cloud3", [record(b"x" * 20 + struct.pack(">iii", NX, NY, NZ))] + [x for t in range(2) for x in [record(stamp(t)), *(record(layers[t][k][v].tobytes()) for k in range(NZ) for v in range(3))]])
    write("landuse", [record(b"LUCAT11 "), record(np.stack([plane() for _ in range(11)]).tobytes()), record(b"TOPO    "), record(surface[0].tobytes())])
    write("old_landuse", [record(np.stack([plane() for _ in range(11)]).tobytes()), record(surface[1].tobytes())])

    def read(name, kind, **o):
        rows = records.read_records(spark, f"file://{tmp_path}/{name}", kind, slab=300, **o).collect()
        got = {(r["step"], r["name"], r["LAY__i"], r["ROW__i"], r["COL__i"]): r["value"] for r in rows}
        assert len(got) == len(rows)
        return got, {(r["date"], r["hour"]) for r in rows}

    def held(got, name, of, steps=2, lays=NZ):
        for t in range(steps):
            for k in range(lays):
                for j, i in np.ndindex(NY, NX):
                    assert got[t, name, k, j, i] == of(t, k)[j, i]

    shape = {"rows": NY, "cols": NX}
    got, times = read("temperature", "temperature", **shape)
    held(got, "AIRTEMP", lambda t, k: layers[t][k][0])
    held(got, "SURFTEMP", lambda t, k: surface[t], lays=1)
    assert times == {(2005185, 0.0), (2005185, 100.0)} and len(got) == 2 * (NZ + 1) * NY * NX
    got, _ = read("height_pressure", "height_pressure", **shape)
    held(got, "HGHT", lambda t, k: layers[t][k][0])
    held(got, "PRES", lambda t, k: layers[t][k][1])
    held(read("humidity", "humidity", **shape)[0], "HUM", lambda t, k: layers[t][k][0])
    got, times = read("wind", "wind", **shape)
    held(got, "U", lambda t, k: layers[t][k][0])
    held(got, "V", lambda t, k: layers[t][k][1])
    assert times == {(2005185, 0.0), (2005185, 100.0)}
    for name, names in (("cloud5", ("CLOUD", "RAIN", "SNOW", "GRAUPEL", "COD")), ("cloud3", ("CLOUD", "PRECIP", "COD"))):
        got, _ = read(name, "cloud_rain")
        for v, n in enumerate(names):
            held(got, n, lambda t, k, v=v: layers[t][k][v])
    got, times = read("landuse", "landuse", **shape)
    held(got, "TOPO", lambda t, k: surface[0], 1, 1)
    assert times == {(None, None)} and len(got) == 12 * NY * NX
    held(read("old_landuse", "landuse", **shape)[0], "TOPO", lambda t, k: surface[1], 1, 1)


def test_lateral_boundary(spark, tmp_path):
    rng = np.random.default_rng(2)
    sides = [("WEST", NY), ("EAST", NY), ("SOUTH", NX), ("NORTH", NX)]
    x = {(t, s, side): rng.random((n, NZ)).astype(">f4") for t in range(2) for s in ("O3", "CO") for side, n in sides}
    about = {"species": ["O3", "CO"], "nz": NZ, "ny": NY, "nx": NX, "steps": 2, "hours": 1.0, "origin": (0.0, 0.0, 1.0, 1.0), "kind": "BOUNDARY", "note": ""}
    raw = records._header(about, 2011001, 0.0, 2) + b"".join(record(struct.pack(">iii", 1, k + 1, n) + b"\0" * 16 * n) for k, (_, n) in enumerate(sides))
    for t in range(2):
        raw += record(struct.pack(">ifif", 2011001, float(t), 2011001, t + 1.0))
        for s in ("O3", "CO"):
            for k, (side, _) in enumerate(sides):
                raw += record(struct.pack(">i", 1) + binary._spaced(s, 10) + struct.pack(">i", k + 1) + x[t, s, side].tobytes())
    (tmp_path / "bc").write_bytes(raw)
    df = records.read_records(spark, f"file://{tmp_path}/bc", "lateral_boundary", slab=500)
    rows = df.collect()
    assert len(rows) == 2 * 2 * 2 * (NY + NX) * NZ
    for r in rows:
        side, s = r["name"].split("_")
        cell = r["ROW__i"] if side in ("WEST", "EAST") else r["COL__i"]
        assert r["value"] == x[r["step"], s, side][cell, r["LAY__i"]] and (r["ROW__i"] is None) == (side in ("SOUTH", "NORTH"))
    assert df.filter("ROW__i = 1").count() == 2 * 2 * 2 * NZ and df.filter("LAY__i = 1 AND name = 'WEST_CO'").count() == 2 * NY


def test_written_by_tasks(spark, tmp_path, average, values):
    df = records.read_records(spark, average)
    path = f"file://{tmp_path}/out"
    write = lambda mode: records.write_average(df, path, ["O3", "NO2"], NZ, NY, NX, steps=2, origin=(0.0, 0.0, 4.0, 4.0), note="made here", mode=mode)
    write("append")
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == [f"average.{k:06d}" for k in range(4)]  # no hidden file is left
    for k in range(4):
        times = [(2011001, float(h), 2011001, h + 1.0) for h in range(2 * k, min(2 * k + 2, NT))]
        want = binary.encode_average(binary.Average("AVERAGE", "made here", (0.0, 0.0, 4.0, 4.0), ["O3", "NO2"], times, values[2 * k : 2 * k + 2]))
        got = (tmp_path / "out" / f"average.{k:06d}").read_bytes()
        assert got == want
    back = records.read_records(spark, path, slab=400).selectExpr("cast(right(file, 6) as int) * 2 + step AS step", "name", "LAY__i", "ROW__i", "COL__i", "value")
    assert _rows(back) == _all(values)
    write("overwrite")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == names
    with pytest.raises(Exception, match="lacks cells"):
        records.write_average(df.filter("NOT (step = 1 AND ROW__i = 0)"), f"file://{tmp_path}/bad", ["O3", "NO2"], NZ, NY, NX, steps=7)


def test_damaged(spark, tmp_path, average):
    raw = records.File(average)
    (tmp_path / "cut").write_bytes(raw.read(0, raw.size - 100))
    got = records.read_records(spark, f"file://{tmp_path}/cut")
    assert got.agg({"step": "max"}).first()[0] == NT - 2  # a step that isn't whole is none
    with pytest.raises(Exception, match="no such records"):
        records.read_records(spark, average, "nothing").count()
