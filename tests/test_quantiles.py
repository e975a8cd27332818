"""Exact quantiles, as-of joins and nearest points against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import quantiles, stats
from gridspark.operators import extract


@pytest.mark.parametrize("n", [1, 2, 3, 10, 41, 999])
def test_quantiles_of_groups(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *[round(rng.gauss(0, 3), 1) for _ in range(8)]]), float(k % 7)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in quantiles.quantiles(df, {"x": F.col("x"), "y": F.col("y")}, points, ["g"]).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        for k, name in ((1, "x"), (2, "y")):
            own = [t[k] for t in rows if t[0] == g and t[k] is not None and t[k] == t[k]]
            if own:
                assert np.allclose(r[name], np.quantile(own, points))
            else:
                assert r[name] == [None] * len(points)


def test_quantiles_of_ties_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 50)  # a bracket far narrower than the values
    x = [5.0] * 4000 + [float(k) for k in range(1000)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert np.allclose(quantiles.quantiles(df, {"x": F.col("x")}, [0.25, 0.5, 0.93]).first()["x"], np.quantile(x, [0.25, 0.5, 0.93]))
    none = quantiles.medians(df.filter("x < 0"), {"x": F.col("x")})
    assert [r["x"] for r in none.collect()] == [None]


def test_all_statistics_have_a_value(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (4.0, 3.0), (None, 1.0)], "obs double, mod double")
    r = stats.evaluate(df).first().asDict()
    assert set(r) == set(stats.STATS) and r["MdnO"] == 2.0 and r["MdnP"] == 2.25 and r["NMdnB"] == pytest.approx(25.0)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_points_are_the_nearest(spark, seed):
    rng = random.Random(seed)
    spread = [lambda: rng.uniform(-180, 180), lambda: rng.choice([0.0, 0.5, 100.0]) + rng.random() * 1e-3, lambda: 3.0][seed]
    grid = [(k, spread(), spread()) for k in range(60)]
    points = [(k, rng.uniform(-200, 400), rng.uniform(-90, 90)) for k in range(80)] + [(80, grid[0][1], grid[0][2]), (81, None, 1.0)]
    p = spark.createDataFrame(points, "p int, lon double, lat double")
    g = spark.createDataFrame(grid, "g int, lon double, lat double")
    got = {r["p"]: r["g"] for r in extract.nearest_points(p, g, ["p"], "g").collect()}
    want = {k: None if x is None else min(grid, key=lambda c: ((x - c[1]) ** 2 + (y - c[2]) ** 2, c[0]))[0] for k, x, y in points}
    assert got == want
    assert [r["g"] for r in extract.nearest_points(p, g.limit(0), ["p"], "g").collect()] == [None] * 82


def test_asof_joins(spark):
    rng = random.Random(1)
    left = [(k, rng.choice("ab"), rng.randrange(0, 400_000)) for k in range(150)] + [(5, "a", 77), (5, "a", 77), (900, "z", 10), (901, "a", None)]
    right = [(rng.choice("ab"), rng.randrange(0, 400_000), float(k)) for k in range(60)]
    stamp = F.timestamp_seconds("s")
    le = spark.createDataFrame(left, "id int, u string, s long").select("id", "u", stamp.alias("ts"), "s")
    ri = spark.createDataFrame(right, "u string, s long, v double").select("u", stamp.alias("ts"), "v")

    def near(u, s):
        c = [(abs(t - s), t, v) for w, t, v in right if w == u and s is not None and abs(t - s) <= 3600]
        return min(c)[2] if c else None

    def last(u, s):
        c = [(t, v) for w, t, v in right if w == u and s is not None and t <= s]
        return max(c)[1] if c else None

    order = lambda rows: sorted(rows, key=repr)
    got = extract.asof(le, ri, ["u"], "ts", "v", 3600).select("id", "u", "s", "matched").collect()
    assert order(map(tuple, got)) == order((k, u, s, near(u, s)) for k, u, s in left)
    got = extract.asof_last(le, ri, ["u"], "ts", "v").select("id", "u", "s", "matched").collect()
    assert order(map(tuple, got)) == order((k, u, s, last(u, s)) for k, u, s in left)


def test_small_and_large_agree(spark, monkeypatch):
    """Exact aggregates of few rows and the bounded ranking give the same statistics and medians."""
    from gridspark.functions import stats
    from gridspark.model import Dataset
    from gridspark.operators import reduce

    rows = spark.range(400).selectExpr("id % 3 AS g", "if(id % 17 = 0, null, cast(id * 37 % 101 as double)) AS obs", "if(id % 13 = 5, null, cast(id * 53 % 97 as double)) AS mod")
    ds = Dataset.from_frame(spark.range(60).selectExpr("cast(id div 20 as int) a__i", "cast(id % 20 as int) b__i", "if(id = 3, null, cast(id * 7 % 23 as double)) v"), {"a": 3, "b": 20}, ["v"])

    def all_of():
        one = [tuple(r) for r in stats.evaluate(rows, by=["g"]).orderBy("g").collect()] + [tuple(r) for r in stats.peaks(rows, ["g"]).collect()]
        two = [tuple(r) for r in reduce.group_stats(rows, ["g"], "obs", (0.25, 0.5)).orderBy("g").collect()]
        return one + two + [tuple(r) for r in reduce.apply_along(ds, b="median").to_frame(order=True).collect()]

    want = all_of()
    monkeypatch.setattr(stats, "SMALL", 0)
    monkeypatch.setattr(reduce, "SMALL", 0)
    for a, b in zip(all_of(), want, strict=True):
        assert all(x == y or abs(x - y) < 1e-9 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)
