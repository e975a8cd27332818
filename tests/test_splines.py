"""Cubic splines against polynomials, which they must meet, and against a plain solution of one line."""

import numpy as np
import pytest

from gridspark.model import Dataset
from gridspark.operators import extract, regrid

X, Y = [0.0, 0.5, 2.0, 3.0, 3.5, 5.0], [-1.0, 0.0, 1.0, 4.0, 4.5]


def _points(spark, xy):
    return spark.createDataFrame([(i, 0, x, y) for i, (x, y) in enumerate(xy)], "n int, t__i int, x double, y double")


def test_cubics_are_met(spark):
    f = lambda x, y: (x**3 - 2 * x**2 + 1) * (0.5 * y**3 + y - 3)
    values = np.array([[[f(x, y) for y in Y] for x in X]])
    ds = Dataset.from_arrays(spark, {"v": values}, {"v": ("t", "a", "b")})
    rng = np.random.default_rng(1)
    xy = [(float(x), float(y)) for x, y in zip(rng.uniform(0, 5, 60), rng.uniform(-1, 4.5, 60), strict=True)] + [(0.0, -1.0), (5.0, 4.5), (2.0, 4.0), (2.0, 4.0)]
    got = {r["n"]: r["matched"] for r in extract.bicubic(_points(spark, xy), ds, "v", ("x", "y"), {"a": X, "b": Y}).collect()}
    assert len(got) == len(xy) and all(abs(got[i] - f(x, y)) < 1e-9 * max(1, abs(f(x, y))) for i, (x, y) in enumerate(xy))
    out = extract.bicubic(_points(spark, [(5.1, 0.0), (1.0, -1.1), (None, 0.0)]), ds, "v", ("x", "y"), {"a": X, "b": Y})
    assert [r["matched"] for r in out.collect()] == [None] * 3
    with pytest.raises(ValueError):
        extract.bicubic(_points(spark, xy).drop("t__i"), ds, "v", ("x", "y"), {"a": X, "b": Y})


def test_masked_cells(spark):
    values = np.ma.masked_equal(np.arange(30.0).reshape(1, 6, 5), 7)
    ds = Dataset.from_arrays(spark, {"v": values}, {"v": ("t", "a", "b")})
    assert extract.bicubic(_points(spark, [(0.2, -0.5), (4.9, 4.4)]), ds, "v", ("x", "y"), {"a": X, "b": Y}).filter("matched IS NOT NULL").count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 50, 400])
def test_weights(n):
    """Sums of weights are the second derivatives of a full solution; far weights vanish."""
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.uniform(0.5, 2, n)), rng.normal(size=n)
    w = regrid.curvature_weights(x.tolist())
    m = np.zeros(n)
    for i, j, v in w:
        m[j] += v * y[i]
    h = np.diff(x)
    for i in range(1, n - 1):  # the slope has no step at a node
        left = (y[i] - y[i - 1]) / h[i - 1] + h[i - 1] * (2 * m[i] + m[i - 1]) / 6
        right = (y[i + 1] - y[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6
        assert abs(left - right) < 1e-8
    if n >= 4:
        assert abs((m[1] - m[0]) / h[0] - (m[2] - m[1]) / h[1]) < 1e-8 and abs((m[-1] - m[-2]) / h[-1] - (m[-2] - m[-3]) / h[-2]) < 1e-8
    assert len(w) <= 90 * n
    with pytest.raises(ValueError):
        regrid.curvature_weights([0.0, 1.0, 1.0])


def test_repeated_points_in_planes(spark):
    """Equal points get equal values, between four cells too."""
    ds = Dataset.from_arrays(spark, {"v": np.arange(6.0).reshape(2, 3)}, {"v": ("a", "b")})
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5), (2, 0.5, 0.5), (3, 2.0, 0.0)], "n int, x double, y double")
    got = extract.bilinear(p, ds.to_frame(), ("x", "y"), (("a__i", [0.0, 1.0]), ("b__i", [0.0, 1.0, 2.0])), "v").collect()
    assert sorted((r["n"], r["matched"]) for r in got if r["n"] < 3) == [(1, 2.0), (2, 2.0), (2, 2.0)] and [r["matched"] for r in got if r["n"] == 3] == [None]
