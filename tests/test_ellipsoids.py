"""Ellipsoidal projections against printed examples and their inverses; mappings to and fro."""

import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions import geo

CLARKE = {"radius": 6378206.4, "minor": 6356583.8}


def _one(spark, proj, lon, lat):
    x, y = proj.forward(F.lit(lon), F.lit(lat))
    a, b = proj.inverse(x, y)
    r = spark.range(1).select(x.alias("x"), y.alias("y"), a.alias("a"), b.alias("b")).first()
    assert abs(r["a"] - lon) < 1e-9 and abs(r["b"] - lat) < 1e-9
    return r["x"], r["y"]


def test_printed_examples(spark):
    """The worked examples of the Geological Survey's manual of projections (Clarke 1866)."""
    x, y = _one(spark, geo.Projection("lcc", 33, 45, 23, -96, **CLARKE), -75.0, 35.0)
    assert abs(x - 1894410.9) < 0.1 and abs(y - 1564649.5) < 0.1
    x, y = _one(spark, geo.Projection("merc", 0, lon_0=-180, **CLARKE), -75.0, 35.0)
    assert abs(x - 11688673.7) < 0.1 and abs(y - 4139145.6) < 0.1
    south = geo.Projection("stere", lat_1=-71, lat_0=-90, lon_0=-100, radius=6378388.0, minor=6378388.0 * math.sqrt(1 - 0.00672267))
    x, y = _one(spark, south, 150.0, -75.0)
    assert abs(x - -1540033.6) < 0.1 and abs(y - -560526.4) < 0.1


@pytest.mark.parametrize("kind", ["lcc", "stere", "merc"])
def test_round_sphere_is_the_limit(spark, kind):
    make = lambda minor: geo.Projection(kind, 30, 60, 90 if kind == "stere" else 40, -97, radius=6_370_000.0, minor=minor)
    a, b = _one(spark, make(None), -120.0, 22.0), _one(spark, make(6_370_000.0 * (1 - 1e-9)), -120.0, 22.0)
    assert abs(a[0] - b[0]) < 0.1 and abs(a[1] - b[1]) < 0.1


@pytest.mark.parametrize("attrs", [
    {"GDTYP": 2, "P_ALP": 33.0, "P_BET": 45.0, "P_GAM": -97.0, "XCENT": -97.0, "YCENT": 40.0, "XORIG": -2e6, "YORIG": 1e6},
    {"GDTYP": 6, "P_ALP": 1.0, "P_BET": 45.0, "P_GAM": -98.0, "XCENT": -98.0, "YCENT": 90.0, "XORIG": -1e6, "YORIG": 5.0},
    {"GDTYP": 7, "P_ALP": 10.0, "P_BET": 0.0, "P_GAM": 5.0, "XCENT": 5.0, "YCENT": 0.0, "XORIG": 0.0, "YORIG": 0.0},
    {"GDTYP": 1, "P_ALP": 0.0, "P_BET": 0.0, "P_GAM": 0.0, "XCENT": 0.0, "YCENT": 0.0, "XORIG": -180.0, "YORIG": -90.0},
])
def test_mappings(attrs):
    for spheroid in (None, "12", "6378206.4 6356583.8"):
        mapping = geo.grid_mapping(attrs, spheroid)
        p = geo.mapped_projection(mapping)
        major, minor = geo.half_axes(spheroid)
        want = geo.grid_projection(attrs, major, minor)
        assert (p.kind, p.radius, p.minor or p.radius) == (want.kind, major, minor)
        if p.kind != "eqc":
            assert (p.lon_0, p.lat_1, p.x_0, p.y_0) == (want.lon_0, want.lat_1, -attrs["XORIG"], -attrs["YORIG"])
        assert geo.proj_text(mapping).startswith("+proj=") and f"+b={minor:.12g}" in geo.proj_text(mapping)
    with pytest.raises(NotImplementedError):
        geo.mapped_projection({"grid_mapping_name": "none"})
    flat = geo.mapped_projection({"grid_mapping_name": "mercator", "semi_major_axis": 6378137.0, "inverse_flattening": 298.257223563})
    assert abs(flat.minor - 6356752.314245) < 1e-4
