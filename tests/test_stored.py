"""Files of the conventions' own kind and of points, written by tasks and read back."""

import numpy as np
import pytest

from gridspark.conventions import Ioapi, read_ioapi, write_ioapi
from gridspark.model import Dataset, Var, idx
from gridspark.plans.gridded import _GRID
from gridspark.sources import records, registry


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.range(7 * 2 * 3 * 4).selectExpr("cast(id div 24 as int) TSTEP__i", "cast(id div 12 % 2 as int) LAY__i", "cast(id div 4 % 3 as int) ROW__i", "cast(id % 4 as int) COL__i", "if(id = 5, null, cast(id as double)) O3", "cast(id as double) / 4 NO2")
    ds = Dataset.from_frame(rows, {"TSTEP": 7, "LAY": 2, "ROW": 3, "COL": 4}, ["O3", "NO2"], {}, {"O3": {"units": "ppbv"}})
    return Ioapi.of(ds, **{**_GRID, "VGLVLS": [1.0, 0.99, 0.9], "STIME": 220000})


@pytest.mark.parametrize("steps", [7, 3, 1])
def test_ioapi_round_trip(spark, tmp_path, made, steps):
    path = f"file://{tmp_path}/out"
    write_ioapi(made, path, steps=steps)
    assert len(list((tmp_path / "out").iterdir())) == -(-7 // steps)
    back = read_ioapi(spark, path)
    assert all(back.audit().values()) and back.ds.dims == {"TSTEP": 7, "LAY": 2, "ROW": 3, "COL": 4}
    for k, v in made.attrs.items():
        got = back.attrs[k]
        assert (np.allclose(got, v) if k == "VGLVLS" else got == v), k
    assert back.ds.vars["O3"].attrs == made.ds.vars["O3"].attrs
    for v in ("O3", "NO2"):
        a, b = made.ds.to_numpy(v), back.ds.to_numpy(v)
        assert (a.mask == b.mask).all() and (a == b).all()
    assert sorted(map(tuple, back.located().select("date", "time").distinct().collect()))[:3] == [(2024001, 220000), (2024001, 230000), (2024002, 0)]


def test_each_file_is_true_of_itself(spark, tmp_path, made):
    path = f"file://{tmp_path}/out"
    registry.save(made.ds, path, "ioapi", steps=3)
    files = sorted(p for p, _ in records._files(path))
    assert [records.detect(records.File(p)) for p in files] == ["netcdf"] * 3
    last = registry.open_dataset(spark, files[2], "ioapi")
    assert last.dims["TSTEP"] == 1 and (last.attrs["SDATE"], last.attrs["STIME"]) == (2024002, 40000)
    flags = registry.open_dataset(spark, files[1])
    assert flags.vars["TFLAG"].dims == ("TSTEP", "VAR", "DATE-TIME")
    got = {(r["TSTEP__i"], r["DATE-TIME__i"]): r["TFLAG"] for r in flags.frame("TFLAG").filter("VAR__i = 1").collect()}
    assert got == {(k, p): (2024002, 10000 * (k + 1))[p] for k in range(3) for p in range(2)}
    with pytest.raises(ValueError, match="variables on"):
        write_ioapi(made.slice(ROW=[0, 1], COL=[0, 1]), path)


def test_points_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 10.0, 1.5, None), (1, 20.0, None, 2.0), (2, 30.0, -3.25, 1e-3)], f"{idx('POINTS')} int, t double, a double, b double")
    ds = Dataset({"POINTS": 3}, {v: Var(("POINTS",), {"units": u}) for v, u in (("t", "s"), ("a", "ppt"), ("b", "K"))}, {("POINTS",): df}, {"PI_NAME": "some one", "note": "of no weight", "SDATE": "2020, 02, 03"}).set_coords("t")
    registry.save(ds, f"file://{tmp_path}/x.ict", "ffi1001")
    back = registry.open_dataset(spark, f"file://{tmp_path}/x.ict")
    assert sorted(map(tuple, back.to_frame(("POINTS",)).select(idx("POINTS"), "t", "a", "b").collect())) == sorted(map(tuple, df.collect()))
    assert back.attrs["PI_NAME"] == "some one" and back.attrs["note"] == "of no weight" and back.vars["a"].attrs["units"] == "ppt" and back.coords == {"t"} and back.dims == {"POINTS": 3}
