"""Operators against numpy on small arrays."""

import warnings

import numpy as np
import pytest

from gridspark.functions import expr
from gridspark.model import Dataset
from gridspark.operators import combine, reduce, regrid, select, window

CUBE = np.arange(120.0).reshape(2, 3, 4, 5)
DIMS = {"test": ("t", "z", "y", "x")}


@pytest.fixture(scope="module")
def ds(spark):
    return Dataset.from_arrays(spark, {"test": CUBE}, DIMS)


@pytest.fixture(scope="module")
def masked(spark):
    return Dataset.from_arrays(spark, {"test": np.ma.masked_where(CUBE % 7 == 0, CUBE)}, DIMS)


def test_slices(ds):
    assert (select.slice_dims(ds, z=1).to_numpy("test") == CUBE[:, 1:2]).all()
    assert (select.slice_dims(ds, x=slice(1, 5, 2), t=-1).to_numpy("test") == CUBE[-1:, :, :, 1:5:2]).all()
    assert (select.slice_dims(ds, x=slice(None, None, -1)).to_numpy("test") == CUBE[..., ::-1]).all()
    assert (select.slice_dims(ds, y=[3, 0, 0]).to_numpy("test") == CUBE[:, :, [3, 0, 0]]).all()
    assert (select.slice_text(ds, "y,1,3").to_numpy("test") == CUBE[:, :, 1:3]).all()
    points = select.slice_dims(ds, "p", y=[0, 3, 3], x=[1, 4, 4])
    assert points.vars["test"].dims == ("t", "z", "p") and points.dims["p"] == 3
    assert (points.to_numpy("test") == CUBE[:, :, [0, 3, 3], [1, 4, 4]]).all()


def test_structure(ds):
    assert (select.split_dim(ds, "y", {"a": 2, "b": 2}).to_numpy("test") == CUBE.reshape(2, 3, 2, 2, 5)).all()
    assert (select.insert_dim(ds, after="t", n=2).to_numpy("test") == np.repeat(CUBE[:, None], 2, axis=1)).all()
    one = select.slice_dims(ds, z=0)
    assert (select.remove_singleton(one).to_numpy("test") == CUBE[:, 0]).all()
    assert (select.reorder(ds, ["x", "t", "z", "y"]).to_numpy("test") == CUBE.transpose(3, 0, 1, 2)).all()
    renamed = select.rename_dims(select.rename_vars(ds, {"test": "a b"}), {"x": "col"})
    assert select.mangle(renamed).vars["a_b"].dims == ("t", "z", "y", "col")


def test_masks(ds):
    got = select.mask(ds, less=10, greater_equal=100, values=55).to_numpy("test")
    want = np.ma.masked_where((CUBE < 10) | (CUBE >= 100) | (CUBE == 55), CUBE)
    assert (np.ma.getmaskarray(got) == want.mask).all() and (got == want).all()


@pytest.mark.parametrize("name", ["min", "max", "mean", "sum", "std", "var"])
def test_reductions(masked, name):
    a = masked.to_numpy("test")
    got = reduce.apply_along(masked, t=name, y=name).to_numpy("test")
    want = getattr(getattr(a, name)(axis=2, keepdims=True), name)(axis=0, keepdims=True)
    assert np.ma.allclose(got, want)


def test_blocks_and_fibres(ds):
    assert np.allclose(reduce.coarsen(ds, "x", 2, "mean").to_numpy("test")[..., 2], CUBE[..., 4])
    assert (reduce.refine(ds, "z", 2).to_numpy("test") == np.repeat(CUBE, 2, axis=1)).all()
    got = reduce.apply_fibres(ds, "x", lambda v: np.convolve(v, [1, 2], "valid"), 4).to_numpy("test")
    assert np.allclose(got, np.apply_along_axis(lambda v: np.convolve(v, [1, 2], "valid"), 3, CUBE))


@pytest.mark.parametrize("mode", ["valid", "same", "full"])
@pytest.mark.parametrize("weights", [[1.0, 2.0, 4.0], [0.5, 0.25]])
def test_convolution(ds, mode, weights):
    got = window.convolve(ds, "x", weights, mode).to_numpy("test")
    assert np.allclose(got, np.apply_along_axis(lambda v: np.convolve(v, weights, mode), 3, CUBE))


def test_neighbours(ds):
    assert np.allclose(window.center(ds, "y", "x").to_numpy("test"), (CUBE[:, :, 1:, 1:] + CUBE[:, :, :-1, 1:] + CUBE[:, :, 1:, :-1] + CUBE[:, :, :-1, :-1]) / 4)
    assert np.allclose(window.depth(ds, "z").to_numpy("test"), np.diff(CUBE, axis=1, prepend=0))
    assert np.allclose(window.running_total(ds, "t").to_numpy("test"), CUBE.cumsum(axis=0))


def test_mda8(spark):
    rng = np.random.default_rng(1)
    a = np.ma.masked_where(rng.random((55, 2)) < 0.3, rng.random((55, 2)))
    ds = Dataset.from_arrays(spark, {"v": a}, {"v": ("h", "s")})
    run = np.ma.masked_all((48, 2))
    for i in range(48):
        w = a[i : i + 8]
        enough = w.count(axis=0) >= 6
        run[i, enough] = w.mean(axis=0)[enough]
    want = run.reshape(2, 24, 2).max(axis=1)
    assert np.ma.allclose(reduce.mda8(ds, "h").to_numpy("v"), want)


def test_arithmetic(ds, masked):
    got = combine.binary("/", ds, masked).to_numpy("test")
    assert np.ma.allclose(got, np.ma.divide(CUBE, masked.to_numpy("test")))
    assert (combine.binary("%", combine.apply_function(lambda c: -c, ds), combine.apply_function(lambda c: c * 0 + 7, ds)).to_numpy("test") == (-CUBE) % 7).all()
    mean = reduce.apply_along(ds, x="mean")
    assert np.allclose(combine.binary("-", ds, mean).to_numpy("test"), CUBE - CUBE.mean(axis=3, keepdims=True))
    assert np.allclose(combine.sequence(["+", "*"], [ds, ds, ds]).to_numpy("test"), 2 * CUBE * CUBE)
    both = combine.stack([select.slice_dims(ds, t=0), select.slice_dims(ds, t=1)], "t")
    assert (both.to_numpy("test") == CUBE).all()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        merged = combine.merge([ds, select.rename_vars(ds, {"test": "other"})])
    assert (merged.to_numpy("other") == CUBE).all()
    with pytest.raises(ValueError):
        combine.merge([ds, Dataset.from_arrays(ds.spark, {"q": np.zeros(9)}, {"q": ("x",)})])


def test_expressions(spark, ds):
    other = Dataset.from_arrays(spark, {"w": np.array([1.0, 0.0, 2.0, 4.0, 8.0])}, {"w": ("x",)})
    got = expr.evaluate(combine.merge([ds, other]), "a = test[:] / w\nb = np.where(a > 10, a, -a) + 2 ** 3")
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.ma.masked_invalid(CUBE / np.array([1.0, 0.0, 2.0, 4.0, 8.0]))
    assert np.ma.allclose(got.to_numpy("a"), a) and np.ma.allclose(got.to_numpy("b"), np.ma.where(a > 10, a, -a) + 8)
    assert set(got.vars) == {"a", "b"}
    for bad in ("x = __import__('os')", "x = test.__class__", "import os", "x = open('f')", "x = [test for _ in 'a']"):
        with pytest.raises((ValueError, SyntaxError)):
            expr.evaluate(ds, bad)


def test_interpolation(ds):
    new = [-1.0, 0.5, 2.25, 9.0]
    got = regrid.interpolate(ds, "x", [0.0, 1.0, 2.0, 3.0, 4.0], new).to_numpy("test")
    assert np.allclose(got, np.apply_along_axis(lambda v: np.interp(new, range(5), v), 3, CUBE))
    down = regrid.interpolate(ds, "x", [4.0, 3.0, 2.0, 1.0, 0.0], new).to_numpy("test")
    assert np.allclose(down, np.apply_along_axis(lambda v: np.interp(new, range(5), v[::-1]), 3, CUBE))
    mass = regrid.overlap_weights([0.0, 1.0, 2.0, 3.0], [0.0, 1.5, 3.0])
    assert np.allclose([w for _, _, w in mass], [2 / 3, 1 / 3, 1 / 3, 2 / 3])


def test_attributes(ds):
    d = ds.edit_attr("units", "test", "o", "ppb").edit_attr("units", "test", "a", "v").edit_attr("x", None, "c", 1)
    assert d.vars["test"].attrs["units"] == "ppbv" and d.attrs["x"] == 1
    assert "units" not in d.edit_attr("units", "test", "d").vars["test"].attrs
    assert "test(t, z, y, x)" in ds.describe()
