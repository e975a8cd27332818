"""Windows along a long dimension, cut in blocks, against the uncut ones; and other plans without single tasks."""

import pytest
from pyspark.sql import functions as F

from gridspark.model import Dataset
from gridspark.operators import extract, reduce, regrid, window
from gridspark.plans import catalog


def _line(spark, n, groups=0):
    v = F.when(F.col("id") % 11 != 3, (F.col("id") * 37 % 101).cast("double"))
    rows = spark.range(n * max(groups, 1)).select((F.col("id") % n).cast("int").alias("t__i"), F.floor(F.col("id") / n).cast("int").alias("g__i"), v.alias("v"), (F.col("id") * 7 % 13).cast("double").alias("w"))
    return Dataset.from_frame(rows, {"g": groups, "t": n} if groups else {"t": n}, ["v", "w"])


OPERATORS = {
    "valid": lambda ds: window.convolve(ds, "t", [0.25, 0.5, 1.0]),
    "same": lambda ds: window.convolve(ds, "t", [0.25, 0.5, 1.0, 2.0], "same"),
    "full": lambda ds: window.convolve(ds, "t", [0.25, 0.5, 1.0], "full"),
    "wide": lambda ds: window.convolve(ds, "t", [1.0] * 20),
    "center": lambda ds: window.center(ds, "t"),
    "difference": lambda ds: window.difference(ds, "t"),
    "steps": lambda ds: window.steps(ds, "t"),
    "total": lambda ds: window.running_total(ds, "t"),
    "destagger": lambda ds: window.destagger(ds, "t", "v"),
    "running_mean": lambda ds: reduce.running_mean(ds, "t", 8, 6),
    "mda8": lambda ds: reduce.mda8(ds, "t"),
}


@pytest.mark.parametrize("groups", [0, 3])
@pytest.mark.parametrize("name", OPERATORS)
def test_blocks(spark, monkeypatch, name, groups):
    rows = lambda: sorted(map(tuple, OPERATORS[name](_line(spark, 100, groups)).to_frame().collect()))
    want = rows()
    for size in (7, 3):
        monkeypatch.setattr(window, "BLOCK", size)
        assert rows() == want


def test_edges_in_blocks(spark, monkeypatch):
    ds = _line(spark, 50).set_coords("w")
    want = sorted(map(repr, window.edges(ds, "w").to_frame(("t",)).collect()))
    monkeypatch.setattr(window, "BLOCK", 7)
    assert sorted(map(repr, window.edges(ds, "w").to_frame(("t",)).collect())) == want


def test_no_task_holds_a_line(spark, monkeypatch):
    """Every window of the plan has the block among its keys."""
    monkeypatch.setattr(window, "BLOCK", 10)
    for name in ("valid", "total", "steps", "running_mean"):
        plan = OPERATORS[name](_line(spark, 1000)).to_frame()._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if line.lstrip("+- :").startswith("Window ")]
        # of running sums only those of the last level, ten at most, are in one place
        keyed = ["block__" in line.rpartition("], [")[0].rpartition("AS ")[2] for line in windows]
        assert windows and keyed.count(False) == (1 if name == "total" else 0), windows
        assert name != "total" or len(windows) == 3


def test_boxes_of_all_sizes(spark):
    """A world-wide box among tiny ones is filed in four cells, not in millions."""
    boxes = [(k * 0.37 - 180, k * 0.37 - 180 + 0.001 * (k % 7), (k * 13 % 170) - 85.0, (k * 13 % 170) - 85.0 + 0.01 * (k % 5)) for k in range(900)]
    boxes += [(-180.0, 180.0, 80.0, 90.0), (5.0, 5.0, 5.0, 5.0), (1.0, 0.0, 0.0, 1.0), (-170.0, -169.999, -90.0, 90.0)]
    points = [(k, -180 + (k * 7919 % 36000) / 100, -90 + (k * 104729 % 18000) / 100) for k in range(3000)] + [(9000 + k, b[0], b[2]) for k, b in enumerate(boxes)] + [(1, None, 2.0), (7, 5.0, 5.0), (7, 5.0, 5.0)]
    p = spark.createDataFrame(points, "id int, lon double, lat double")
    b = spark.createDataFrame(boxes, "x0 double, x1 double, y0 double, y1 double")
    got = sorted(tuple(r) for r in extract.in_any_box(p, b, "lon", "lat").collect())
    assert got == sorted(q for q in points if q[1] is not None and any(x0 <= q[1] <= x1 and y0 <= q[2] <= y1 for x0, x1, y0, y1 in boxes))


def test_asof_zero(spark):
    left = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 00:00:01') AS t(k, ts)")
    right = spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS ts, 5.0 AS x")
    got = {r["k"]: r["matched"] for r in extract.asof(left.withColumn("g", F.lit(1)), right.withColumn("g", F.lit(1)), ["g"], "ts", "x", 0).collect()}
    assert got[1] is None and float(got[2]) == 5.0


def test_layer_mean_has_no_join_of_rows(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "cast(id as double) AS z", "1.0D AS v", "2.0D AS w")
    out = regrid.layer_mean(df, ["g"], "z", "v", "w", [0.0, 10.0, 50.0, 200.0])
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 9 and {r["mean"] for r in out.collect()} == {0.5}


def test_cube_takes_all_events(spark, tmp_path):
    """Events of any hour and kind have their place."""
    spark.sql("SELECT * FROM VALUES (timestamp_ntz'2023-12-30 05:10:00', 'new', 1.0D), (timestamp_ntz'2024-01-31 23:00:00', 'view', 2.0D), (timestamp_ntz'2024-01-02 00:00:00', 'sixth', 3.0D), (NULL, 'view', 4.0D) AS t(ts, event_type, value)").write.parquet(str(tmp_path / "events.parquet"))
    ds = catalog.event_cube(spark, str(tmp_path))
    assert ds.dims == {"hour": 33 * 24, "etype": 3}
    rows = ds.to_frame().filter("v IS NOT NULL").collect()
    assert sorted((r["hour__i"], r["etype__i"], r["v"]) for r in rows) == [(5, 0, 1.0), (72, 1, 3.0), (33 * 24 - 1, 2, 2.0)]


def test_hours_reach_the_scan(spark):
    plan = catalog.queries()["slice_dim"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-05T04:00" in plan and "LessThan(ts,2024-01-09T08:00" in plan
