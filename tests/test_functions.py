"""Lookups, times, projections, units and statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import geo, met, stats, times, units
from gridspark.operators import extract


def test_val2idx(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.25, 4.5, 4.99, 5.0, 6.75, 10.0, None)], "v double")
    coord = [k + 0.5 for k in range(8)]
    got = lambda **k: [r.i for r in extract.val2idx(df, "v", coord, **k).collect()]
    assert got() == [0, 0, 4, 4, 4, 6, 7, None]
    assert got(method="bounds") == [None, 0, 4, 4, 5, 6, None, None]
    assert got(method="bounds", clean="clip") == [0, 0, 4, 4, 5, 6, 7, None]
    assert got(method="exact") == [None, None, 4, None, None, None, None, None]
    down = [r.i for r in extract.val2idx(df, "v", coord[::-1]).collect()]
    assert down == [7, 7, 3, 3, 2, 1, 0, None]


def test_nearest_points(spark):
    rng = np.random.default_rng(4)
    p = [(i, *map(float, x)) for i, x in enumerate(rng.uniform(-20, 20, (60, 2)))] + [(99, 170.0, 80.0)]
    g = [(i, *map(float, x)) for i, x in enumerate(rng.uniform(-20, 20, (40, 2)))]
    got = {r.k: r.cell for r in extract.nearest_points(spark.createDataFrame(p, "k int, lon double, lat double"), spark.createDataFrame(g, "cell int, lon double, lat double"), ["k"], "cell").collect()}
    at = np.array(g)[:, 1:]
    assert got == {i: int(((at - (x, y)) ** 2).sum(axis=1).argmin()) for i, x, y in p}


def test_time_codecs(spark):
    assert times.parse_reference("hours since 1985-01-01 00:00:00+0100")[1].isoformat() == "1984-12-31T23:00:00+00:00"
    assert times.parse_reference("days since 2000-1-1")[0] == "day"
    with pytest.raises(ValueError):
        times.parse_reference("moons since 2000-01-01")
    df = spark.createDataFrame([(36.5,)], "h double").select(times.from_number(F.col("h"), "hours since 2011-01-01 00:00:00 UTC").alias("t"))
    r = df.select("t", times.yyyyjjj(F.col("t")).alias("d"), times.hhmmss(F.col("t")).alias("s"), times.to_number(F.col("t"), "hours since 2011-01-01").alias("h")).first()
    assert (r.d, r.s, r.h) == (2011002, 123000, 36.5)
    assert times.add_hours(2010365, 2300.0, 2) == (2011001, 100.0) and times.hours_between((2010365, 2300.0), (2011001, 100.0)) == 2


@pytest.mark.parametrize("p", [geo.Projection("lcc", 33, 45, 40, -97), geo.Projection("stere", 60, 0, 90, -98), geo.Projection("merc", 20, 0, 0, 10), geo.Projection("eqc")])
def test_projection_round_trip(spark, p):
    df = spark.createDataFrame([(-100.0, 40.0), (-60.0, 10.0), (10.0, 70.0)], "lon double, lat double")
    x, y = p.forward(F.col("lon"), F.col("lat"))
    lon, lat = p.inverse(x, y)
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.a - r.lon) < 1e-8 and abs(r.b - r.lat) < 1e-8


def test_units_and_met(spark):
    r = spark.range(1).select(units.convert(F.lit(300.0), "K", "C").alias("c"), units.convert(F.lit(26.8), "C", "K").alias("k"), met.relative_humidity(F.lit(20.0), F.lit(20.0)).alias("rh"), *[c.alias(n) for n, c in zip("sd", met.wind_speed_direction(*met.wind_components(F.lit(5.0), F.lit(230.0))), strict=True)]).first()
    assert abs(r.c - 26.8) < 1e-9 and abs(r.k - 300) < 1e-9 and abs(r.rh - 100) < 1e-9 and abs(r.s - 5) < 1e-9 and abs(r.d - 230) < 1e-9
    with pytest.raises(ValueError):
        units.convert(F.lit(1.0), "K", "m")


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(9)
    o = np.ma.masked_where(rng.random(200) < 0.1, rng.uniform(10, 90, 200))
    m = np.ma.masked_where(rng.random(200) < 0.1, o.data + rng.normal(3, 9, 200))
    rows = [(None if a is np.ma.masked else float(a), None if b is np.ma.masked else float(b)) for a, b in zip(o, m, strict=True)]
    got = stats.evaluate(spark.createDataFrame(rows, "obs double, mod double")).first().asDict()
    e, om = m - o, o.mean()
    both = ~(np.ma.getmaskarray(o) | np.ma.getmaskarray(m))
    slope, start = np.polyfit(o.data[both], m.data[both], 1)
    line = slope * o + start
    want = {
        "MB": e.mean(), "NMB": e.sum() / o.sum() * 100, "MdnE": np.ma.median(abs(e)), "FE": (abs(e) / (m + o)).mean() * 200, "RMSE": np.sqrt((e**2).mean()), "STDO": o.std(), "NOP": both.sum(), "R2": np.corrcoef(o.data[both], m.data[both])[0, 1] ** 2,
        "IOA": 1 - (e**2).sum() / ((abs(m - om) + abs(o - om)) ** 2).sum(), "d1": 1 - abs(e).sum() / (abs(m - om) + abs(o - om)).sum(), "E1": 1 - abs(e).sum() / abs(o - om).sum(),
        "AC": ((m - om) * (o - om)).sum() / np.sqrt(((m - om) ** 2).sum() * ((o - om) ** 2).sum()), "RMSEs": np.sqrt(np.ma.masked_array((line - o) ** 2, ~both).mean()), "RMSEu": np.sqrt(((line - m) ** 2).mean()),
    }
    want["AC"] = ((m - om) * (o - om)).sum() / np.sqrt(((m - om) ** 2).sum() * ((o - om) ** 2).sum())
    for k, v in want.items():
        assert np.isclose(got[k], v), k
    assert set(stats.STATS) <= set(got) and len(stats.STATS) + len(stats.PAIRED_PEAK) + len(stats.PEAK) >= 50
