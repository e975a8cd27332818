"""Attributes after operators, against what the cells themselves say."""

import random
import warnings

import pytest

from gridspark.conventions import Ioapi, as_hms, drop_tflag, is_ioapi, seconds, to_ioapi
from gridspark.model import Dataset, idx
from gridspark.plans.gridded import _GRID


@pytest.fixture(scope="module")
def made(spark):
    """Each cell's value is its own place, so that located() can be held against it."""
    n = {"TSTEP": 24, "LAY": 4, "ROW": 5, "COL": 6}
    rows = spark.range(24 * 4 * 5 * 6).selectExpr("cast(id div 120 as int) TSTEP__i", "cast(id div 30 % 4 as int) LAY__i", "cast(id div 6 % 5 as int) ROW__i", "cast(id % 6 as int) COL__i", "cast(id as double) O3", "cast(id as double) * 0.05 NO2")
    return Ioapi.of(Dataset.from_frame(rows, n, ["O3", "NO2"], {}, {"O3": {"units": "ppbv"}}), **_GRID)


def _check(f):
    """Every cell lies where its value says it came from."""
    assert all(f.audit().values()), f.audit()
    for r in f.located().collect():
        i = int(r["O3"])
        t, k, y, x = i // 120, i // 30 % 4, i // 6 % 5, i % 6
        assert (r["date"], r["time"]) == (2024001, t * 10000)
        for name, want in (("x", -2736000 + (x + 0.5) * 36000), ("y", -2088000 + (y + 0.5) * 36000), ("lower", 1 - k * 0.0025), ("upper", 1 - (k + 1) * 0.0025)):
            if name in r:
                assert abs(r[name] - want) < 1e-6, (name, r)


def test_defaults(made):
    assert made.attrs["NVARS"] == 2 and made.attrs["VAR-LIST"] == "O3".ljust(16) + "NO2".ljust(16)
    assert made.ds.vars["O3"].attrs["units"] == "ppbv".ljust(16) and made.ds.vars["NO2"].attrs["units"] == "unknown".ljust(16)
    assert len(made.ds.vars["O3"].attrs["var_desc"]) == 80
    _check(made)


def test_slices(made):
    rng = random.Random(5)
    for _ in range(6):
        by = {}
        for d, n in (("TSTEP", 24), ("LAY", 4), ("ROW", 5), ("COL", 6)):
            a = rng.randrange(n)
            by[d] = rng.choice([a, slice(a, None), slice(None, None, 2), slice(a, a + 1), [a], slice(None, None, -1)])
        if not isinstance(by["LAY"], int) and not (isinstance(by["LAY"], slice) and by["LAY"].step is None):
            by["LAY"] = slice(1, 3)
        if by["TSTEP"] == slice(None, None, -1):
            by["TSTEP"] = slice(3, None, 4)
        _check(made.slice(**by))
    one = made.slice(TSTEP=[3, 4, 9])
    assert (one.attrs["SDATE"], one.attrs["STIME"], one.attrs["TSTEP"], one.attrs["STEP_SECONDS"]) == (2024001, 30000, 0, [0, 3600, 21600])
    _check(one)
    again = one.slice(TSTEP=slice(1, None))
    assert (again.attrs["STIME"], again.attrs["TSTEP"]) == (40000, 50000) and "STEP_SECONDS" not in again.attrs
    _check(again)
    assert one.slice(TSTEP=1).attrs["STIME"] == 40000


def test_uneven_cells_lose_their_grid(made):
    with pytest.warns(UserWarning):
        f = made.slice(COL=[0, 1, 4])
    assert "XORIG" not in f.attrs and f.attrs["NCOLS"] == 3 and f.attrs["YORIG"] == -2088000
    assert "x" not in f.located().columns
    p = made.slice(ROW=[1, 2], COL=[3, 0])
    assert "XORIG" not in p.attrs and "YORIG" not in p.attrs and "NROWS" not in p.attrs
    gap = made.slice(LAY=[0, 2, 3])
    assert gap.attrs["VGLVLS"] == [1.0, 0.995, 0.9925, 0.99] and gap.attrs["NLAYS"] == 3


def test_reductions(made):
    f = made.apply(TSTEP="mean", LAY="mean")
    assert (f.attrs["SDATE"], f.attrs["STIME"], f.attrs["TSTEP"], f.attrs["NLAYS"]) == (2024001, 0, 240000, 1)
    assert f.attrs["VGLVLS"] == pytest.approx([0.99625, 0.99375])
    f = made.coarsen("TSTEP", 6, "mean").coarsen("COL", 2, "sum").coarsen("LAY", 2, "mean")
    assert (f.attrs["TSTEP"], f.attrs["XCELL"], f.attrs["NCOLS"]) == (60000, 72000, 3) and f.attrs["VGLVLS"] == [1.0, 0.995, 0.99]
    x = sorted({r["x"] for r in f.located().collect()})
    assert x == [-2736000 + 36000 * k for k in (1, 3, 5)]
    r = made.refine("ROW", 2).refine("TSTEP", 4)
    assert (r.attrs["YCELL"], r.attrs["NROWS"], r.attrs["TSTEP"], r.attrs["YORIG"]) == (18000, 10, 1500, -2088000)
    c = made.convolve("TSTEP", [0.5, 0.5])
    assert c.ds.dims["TSTEP"] == 23 and c.attrs["TSTEP"] == 10000 and c.times().count() == 23


def test_variables(made):
    f = made.eval("SUM = O3 + NO2", copy_all=True)
    assert f.attrs["NVARS"] == 3 and f.attrs["VAR-LIST"].split() == ["O3", "NO2", "SUM"]
    assert f.subset(["NO2"]).attrs["VAR-LIST"] == "NO2".ljust(16)
    assert f.rename({"O3": "OZONE"}).attrs["VAR-LIST"].split() == ["OZONE", "NO2", "SUM"]
    assert f.mask(less=3).attrs["NVARS"] == 3
    flags = f.with_tflag()
    assert is_ioapi(flags) and flags.dims["VAR"] == 3 and flags.to_frame(("TSTEP", "VAR", "DATE-TIME")).count() == 24 * 3 * 2
    back = drop_tflag(flags)
    assert back.attrs["NVARS"] == 3 and "TFLAG" not in back.ds.vars
    assert not f.ds.attrs.get("x") and all(back.audit().values())


def test_stack(made):
    _check(made.slice(TSTEP=slice(0, 10)).stack(made.slice(TSTEP=slice(10, None))))
    with pytest.warns(UserWarning):
        f = made.slice(TSTEP=slice(0, 3)).stack(made.slice(TSTEP=slice(20, None)), made.slice(TSTEP=7))
    _check(f)
    assert f.attrs["STEP_SECONDS"] == [3600 * h for h in (0, 1, 2, 20, 21, 22, 23, 7)]
    _check(made.slice(LAY=slice(0, 1)).stack(made.slice(LAY=slice(1, None)), dim="LAY"))
    with pytest.warns(UserWarning):
        assert "VGLVLS" not in made.slice(LAY=slice(0, 1)).stack(made.slice(LAY=slice(2, None)), dim="LAY").attrs


def test_sigma(made):
    f = made.interpolate_sigma([1.0, 0.995, 0.99], kind="conserve")
    assert f.attrs["NLAYS"] == 2 and f.attrs["VGLVLS"] == [1.0, 0.995, 0.99] and all(f.audit().values())


def test_from_elsewhere(spark):
    rows = spark.range(6).selectExpr("cast(id div 3 as int) time__i", "cast(id % 3 as int) lon__i", "cast(id as double) a_very_long_name_indeed")
    f = to_ioapi(spark, Dataset.from_frame(rows, {"time": 2, "lon": 3}, ["a_very_long_name_indeed"]), SDATE=2020366, STIME=230000)
    assert f.ds.dims == {"TSTEP": 2, "COL": 3, "LAY": 1, "ROW": 1} and f.variables() == ["a_very_long_name"] and f.attrs["NCOLS"] == 3
    assert [(r["date"], r["time"]) for r in f.located().orderBy(idx("TSTEP")).collect()][::3] == [(2020366, 230000), (2021001, 0)]


def test_hms():
    assert [seconds(x) for x in (10000, 1680000, -3000, 130)] == [3600, 604800, -1800, 90]
    assert [as_hms(x) for x in (3600, 604800, -1800, 90)] == [10000, 1680000, -3000, 130]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
