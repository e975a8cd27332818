"""Layers whose edges differ by column and move with time, against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridspark.operators import extract, regrid


def test_overlaps(spark):
    rng = random.Random(3)
    old, new, want = [], [], {}
    for c in range(12):
        sides = []
        for n in (7, 4):
            edges = sorted(rng.sample(range(40), n + 1))
            gap = rng.randrange(n)
            layers = [(k, edges[k], edges[k + 1]) for k in range(n) if c % 3 or k != gap]
            sides.append([(k, b, a) for k, a, b in layers] if c % 2 else layers)
        old += [(c, k, float(a), float(b), float(k * c) if k != 2 else None) for k, a, b in sides[0]]
        new += [(c, k, float(a), float(b)) for k, a, b in sides[1]]
        for j, a, b in sides[1]:
            parts = [(k, max(0, min(max(a, b), max(x, y)) - max(min(a, b), min(x, y)))) for k, x, y in sides[0]]
            used = [(k * c, w) for k, w in parts if w and k != 2]
            want[c, j] = sum(v * w for v, w in used) / sum(w for _, w in used) if used else None
    o = spark.createDataFrame(old, "c int, layer int, lower double, upper double, v double")
    n = spark.createDataFrame(new, "c int, layer int, lower double, upper double")
    got = {(r["c"], r["layer"]): r["v"] for r in regrid.remap_columns(o, n, ["c"], ["v"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == w or abs(got[k] - w) < 1e-12 for k, w in want.items())
    plan = regrid.column_overlaps(o, n, ["c"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
    assert regrid.remap_columns(o.limit(0), n, ["c"], ["v"]).filter("v IS NOT NULL").count() == 0


def test_nothing_is_broadcast_that_grows_with_the_columns(spark):
    """Column counts look small to a planner that doesn't know their layers."""
    rows = spark.range(3000).selectExpr("cast(id as int) c", "900.0 + id % 90 AS ps")
    a, b = [0.0] * 41, [1 - k / 40 for k in range(41)]
    old = regrid.hybrid_edges(rows, a, b, "ps").withColumn("v", F.col("layer") * 1.0)
    new = regrid.hybrid_edges(rows.distinct(), a[:11], [1 - j / 10 for j in range(11)], "ps")
    out = regrid.remap_columns(old, new, ["c"], ["v"])
    assert {r["layer"]: round(r["v"], 9) for r in out.groupBy("layer").agg(F.max("v").alias("v")).collect()} == {j: 4 * j + 1.5 for j in range(10)}
    assert out.count() == 30000
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_edges_of_cells(spark):
    cells = spark.createDataFrame([(0, -1), (0, 0), (0, 1), (0, 2), (0, None)], "c int, layer int").withColumn("ps", F.lit(100.0))
    got = [(r["layer"], r["lower"], r["upper"]) for r in regrid.hybrid_at(cells, [0.0, 10.0, 20.0], [1.0, 0.5, 0.0], "ps").collect()]
    assert got == [(-1, None, None), (0, 100.0, 60.0), (1, 60.0, 20.0), (2, None, None), (None, None, None)]


def test_conserves(spark):
    """What a column holds stays, where both reach equally far."""
    rows = spark.range(50).selectExpr("cast(id as int) c", "900.0 + id AS ps")
    a, b = [0.0, 10.0, 20.0, 5.0], [1.0, 0.6, 0.2, 0.0]
    old = regrid.hybrid_edges(rows, a, b, "ps").selectExpr("*", "ps * (layer + 1) AS v")
    new = regrid.hybrid_edges(rows, [5 * j / 5 for j in range(6)], [1 - j / 5 for j in range(6)], "ps")
    mass = lambda df: {r["c"]: r["m"] for r in df.groupBy("c").agg({"m": "sum"}).withColumnRenamed("sum(m)", "m").collect()}
    before = mass(old.selectExpr("c", "v * (lower - upper) AS m"))
    after = mass(regrid.remap_columns(old, new, ["c"], ["v"]).join(new, ["c", "layer"]).selectExpr("c", "v * (lower - upper) AS m"))
    assert np.allclose([before[c] for c in range(50)], [after[c] for c in range(50)])


def test_points_in_layers(spark):
    rng = random.Random(8)
    layers = []
    for t in range(5):
        z = 0.0
        for k in range(12):
            d = rng.choice([0.001, 0.5, 3.0, 700.0])
            layers.append((t, k, z, z + d) if t % 2 else (t, k, z + d, z))
            z += d + (1.0 if k == 5 else 0.0)  # a gap
    points = [(i, rng.randrange(6), rng.choice([rng.uniform(-5, 900), rng.choice(layers)[2]]), 7) for i in range(400)] + [(1000, 0, None, 7), (1001, None, 1.0, 7), (3, 2, 0.0, 7), (3, 2, 0.0, 7)]
    p = spark.createDataFrame(points, "id int, t int, z double, layer int")
    x = spark.createDataFrame(layers, "t int, layer int, lower double, upper double")
    got = sorted(((r["id"], r["t"], r["z"], r["layer_layer"]) for r in extract.in_layers(p, x, ["t"], "z", "lower", "upper").collect()), key=repr)

    def of(t, z):
        return next((k for s, k, a, b in layers if s == t and z is not None and min(a, b) <= z < max(a, b)), None)

    assert got == sorted(((i, t, z, of(t, z)) for i, t, z, _ in points), key=repr)
    plan = extract.in_layers(p, x, ["t"], "z", "lower", "upper")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan.replace("Join Cross", "", 1)  # the one row of sizes alone
