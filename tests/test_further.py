"""Operators that the registered queries can't show alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import geo, times
from gridspark.model import Dataset
from gridspark.operators import combine, extract, regrid, select


def test_masks_from_text(spark):
    a = np.arange(6.0).reshape(2, 3)
    ds = Dataset.from_arrays(spark, {"a": a, "b": a * 10}, {"a": ("y", "x"), "b": ("y", "x")})
    got = {t: select.mask_text(ds, t).to_numpy("a") for t in ("less,2", "not_equal,3", "outside,4,1", "where,(a > 1) & (b < 40)", "values,3")}
    want = {"less,2": a < 2, "not_equal,3": a != 3, "outside,4,1": (a < 1) | (a > 4), "where,(a > 1) & (b < 40)": (a > 1) & (a < 4), "values,3": a == 3}
    for t, m in want.items():
        assert (np.ma.getmaskarray(got[t]) == m).all(), t
    with pytest.raises(ValueError):
        select.mask_text(ds, "nothing,1")


def test_spheroids_and_levels():
    assert geo.half_axes() == (6_370_000.0, 6_370_000.0) and geo.half_axes("12") == (6378137.0, 6356752.314245) and geo.half_axes("5e6 4e6") == (5e6, 4e6) and len(geo.SPHEROIDS) == 22
    assert geo.half_axes("6371200") == (6371200.0, 6371200.0)
    with pytest.raises(ValueError):
        geo.half_axes("1 2 3")
    assert geo.sigma_edges({}, [1000.0, 550.0, 100.0]) == [1.0, 0.5, 0.0] and geo.sigma_edges({"NLAYS": 3}) == [0.0, 1.0, 2.0]
    assert geo.pressure_edges({"VGLVLS": [1, 0.5, 0], "VGTOP": 1325.0}) == [101_325.0, 51_325.0, 1325.0] and geo.middles([1.0, 0.5, 0.0]) == [0.75, 0.25]


def test_perimeter_by_sides(spark):
    ds = Dataset.from_arrays(spark, {"a": np.arange(8.0).reshape(2, 4)}, {"a": ("LAY", "SIDE")})
    got = regrid.to_perimeter(ds, 2, 3).to_numpy("a")
    assert got.shape == (2, 14) and list(got[1]) == [4.0] * 4 + [5.0] * 3 + [6.0] * 4 + [7.0] * 3


def test_bilinear_edges_and_masks(spark):
    g = spark.createDataFrame([(i, j, None if (i, j) == (2, 2) else 10.0 * i + j) for i in range(3) for j in range(3)], "i int, j int, z double")
    p = spark.createDataFrame([(1, 0.5, 0.25), (2, 20.0, 2.0), (3, 15.0, 1.5), (4, -1.0, 0.0), (5, None, 1.0), (6, 20.0, 1.0)], "p int, x double, y double")
    got = dict(extract.bilinear(p, g, ("x", "y"), (("i", [0.0, 10.0, 20.0]), ("j", [0.0, 1.0, 2.0])), "z").select("p", "matched").collect())
    assert got == {1: pytest.approx(0.75), 2: None, 3: None, 4: None, 5: None, 6: pytest.approx(21.0)}


def test_pieces_of_dates(spark):
    df = spark.createDataFrame([(68, 1, 2, 3, 4), (69, 1, 2, 3, 4), (2010, 12, 31, 23, 59), (10, 13, 1, 0, 0)], "y int, m int, d int, h int, n int")
    got = [r[0] for r in df.select(times.from_pieces(*[F.col(c) for c in "ymdhn"]).cast("string")).collect()]
    assert got == ["2068-01-02 03:04:00", "1969-01-02 03:04:00", "2010-12-31 23:59:00", None]


def test_reactions_of_zero_and_missing(spark):
    df = spark.createDataFrame([("r", "O3", -1.5), ("r", "NO", -2.0), ("r", "NO2", 3.0), ("r", "X", 0.0), ("q", "X", None)], "r string, s string, v double")
    assert dict(combine.reaction_texts(df, ["r"], "s", "v").collect()) == {"r": "2.000000 NO + 1.500000 O3 <-> 3.000000 NO2", "q": " <-> "}
