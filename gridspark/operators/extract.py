"""Lookups and joins by value: coordinates, nearest points, times with tolerance, polygons."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.quantiles import join_groups
from gridspark.model import Dataset, idx
from gridspark.operators.regrid import curvature_weights


def val2idx(df: DataFrame, value: str, coord: list[float], method: str = "nearest", edges: list[float] | None = None, name: str = "i", clean: str = "mask") -> DataFrame:
    """Adds the index of a value on a small coordinate axis.

    nearest: the interpolated index, rounded half to even, ends held; bounds: the cell between
    edges (midpoints unless given), NULL outside (``clean='clip'`` holds the ends); exact: equal values only.
    A descending axis works as an ascending one.
    """
    n = len(coord)
    order = sorted(range(n), key=lambda k: coord[k])
    xs = [float(coord[k]) for k in order]
    flip = order and order[0] != 0
    v = F.col(value).cast("double")
    if method == "exact":
        at = reduce(lambda acc, k: acc.when(v == xs[k], order[k]), range(n), F.when(F.lit(False), F.lit(None).cast("int")))
        return df.withColumn(name, at.cast("int"))
    axis = F.array(*[F.lit(x) for x in xs])
    if method == "nearest":
        # the segment that holds the value, found on the axis as an array: its size is the axis'
        k = F.least(F.greatest(F.size(F.filter(axis, lambda x: x <= v)) - 1, F.lit(0)), F.lit(max(n - 2, 0)))
        lo, hi = F.get(axis, k), F.get(axis, k + 1)
        t = F.least(F.lit(float(n - 1)), F.greatest(F.lit(0.0), F.coalesce(k + F.least(F.greatest(F.try_divide(v - lo, hi - lo), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))))
        t = (n - 1) - t if flip else t
        return df.withColumn(name, F.when(v.isNotNull(), F.rint(t)).cast("int"))
    if method != "bounds":
        raise ValueError(f"no such method: {method}")
    if edges is None:
        mid = [(a + b) / 2 for a, b in zip(xs, xs[1:], strict=False)]
        cuts = [xs[0] - (mid[0] - xs[0]), *mid, xs[-1] + (xs[-1] - mid[-1])] if n > 1 else [xs[0] - 0.5, xs[0] + 0.5]
    else:
        cuts = sorted(map(float, edges))
    k = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= v)) - 1
    k = F.when(v == cuts[-1], F.lit(n - 1)).otherwise(k)
    k = F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)) if clean == "clip" else F.when((k >= 0) & (k < n), k)
    return df.withColumn(name, F.when(v.isNotNull(), (n - 1) - k if flip else k).cast("int"))


def nearest_points(points: DataFrame, grid: DataFrame, key: list[str], grid_index: str, xy: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """The grid cell nearest to each point in plain degrees; of equal distances the least index.

    Grid cells are filed in squares of doubling sizes.  The smallest square size at which a
    point has a cell in its own or a neighbouring square bounds the distance by three of
    these squares, so the squares four times as large around the point hold the nearest:
    two joins by equality, at any density.  Points without coordinates have no cell (NULL).
    """
    x, y = xy
    g = grid.select(F.col(grid_index).alias("g__"), F.col(x).cast("double").alias("gx__"), F.col(y).cast("double").alias("gy__")).dropna()
    p = points.select(*key, F.col(x).cast("double").alias("px__"), F.col(y).cast("double").alias("py__")).distinct()
    ends = lambda df, a, b: df.agg(*[f(c).alias(f"{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))], F.count(a).alias(f"n_{a}"))
    r = ends(g, "gx__", "gy__").crossJoin(ends(p, "px__", "py__")).first()
    if not r["n_gx__"] or not r["n_px__"]:
        return p.select(*key, F.lit(None).cast(grid.schema[grid_index].dataType).alias(grid_index), F.lit(None).cast("double").alias("d2"))
    wide, high = r["hi_gx__"] - r["lo_gx__"], r["hi_gy__"] - r["lo_gy__"]
    size = math.sqrt(wide * high / r["n_gx__"]) or max(wide, high) / r["n_gx__"] or 1.0
    known = [(min(r["lo_gx__"], r["lo_px__"]), max(r["hi_gx__"], r["hi_px__"])), (min(r["lo_gy__"], r["lo_py__"]), max(r["hi_gy__"], r["hi_py__"]))]
    # at the last size any two squares touch
    last = max(0, math.ceil(math.log2(max(max(b - a for a, b in known) / size, 1.0))))
    square = lambda c: F.floor(c / (F.lit(size) * F.pow(F.lit(2.0), F.col("l__"))))
    levels = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    near = lambda df: df.withColumn("i__", F.explode(around)).withColumn("j__", F.explode(around)).withColumns({"sx__": F.col("sx__") + F.col("i__"), "sy__": F.col("sy__") + F.col("j__")}).drop("i__", "j__")
    filed = g.withColumn("l__", levels(last + 2)).withColumns({"sx__": square(F.col("gx__")), "sy__": square(F.col("gy__"))})
    touched = near(filed.filter(F.col("l__") <= last).select("l__", "sx__", "sy__").distinct()).distinct()
    own = [*key, "px__", "py__"]
    at = p.withColumn("l__", levels(last)).withColumns({"sx__": square(F.col("px__")), "sy__": square(F.col("py__"))})
    first = at.join(touched, ["l__", "sx__", "sy__"]).groupBy(*own).agg((F.min("l__") + 2).alias("l__"))
    search = near(first.withColumns({"sx__": square(F.col("px__")), "sy__": square(F.col("py__"))}))
    d2 = (F.col("px__") - F.col("gx__")) ** 2 + (F.col("py__") - F.col("gy__")) ** 2
    best = search.join(filed, ["l__", "sx__", "sy__"]).groupBy(*key).agg(F.min(F.struct(d2.alias("d2"), F.col("g__"))).alias("best__"))
    return p.select(*key).distinct().join(best, key, "left").select(*key, F.col("best__.g__").alias(grid_index), F.col("best__.d2").alias("d2"))


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, tolerance_s: int) -> DataFrame:
    """Adds to each left row the right value nearest in time within a tolerance (NULL if none); the earlier of two as near.

    Time is cut in buckets of the tolerance.  A right row goes to its own bucket and both
    neighbours, a left row to its own, where it sees the last right row up to it and the
    first one from it on; so a busy key is spread over its buckets.  Of right rows of one
    time the least value counts.
    """
    sec = lambda c: F.unix_micros(c.cast("timestamp"))
    width = max(1, tolerance_s * 1_000_000)  # equal times alone still need a bucket
    bucket = F.floor(F.col("t__") / width)
    r = right.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).select(*by, sec(F.col(time)).alias("t__"), F.col(value).alias("rv__")).withColumn("b__", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumn("side__", F.lit(0))
    both = left.withColumn("t__", sec(F.col(time))).withColumns({"b__": bucket, "side__": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    seen = F.when(F.col("side__") == 0, F.struct("t__", "rv__"))
    own = Window.partitionBy(*by, "b__").rowsBetween(Window.unboundedPreceding, 0)
    before = F.last(seen, ignorenulls=True).over(own.orderBy("t__", "side__", F.col("rv__").desc()))
    after = F.last(seen, ignorenulls=True).over(own.orderBy(F.col("t__").desc(), "side__", F.col("rv__").desc()))
    rows = both.withColumns({"p__": before, "n__": after}).filter("side__ = 1")
    gap = lambda c: F.when(F.abs(F.col(c)["t__"] - F.col("t__")) <= width, F.abs(F.col(c)["t__"] - F.col("t__")))
    rows = rows.withColumns({"gp__": gap("p__"), "gn__": gap("n__")})
    earlier = F.col("gp__").isNotNull() & (F.col("gn__").isNull() | (F.col("gp__") <= F.col("gn__")))
    matched = F.when(earlier, F.col("p__")["rv__"]).when(F.col("gn__").isNotNull(), F.col("n__")["rv__"])
    return rows.select(*left.columns, matched.alias("matched"), (F.least("gp__", "gn__") / 1e6).alias("gap_s"))


def asof_last(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, block: str = "day") -> DataFrame:
    """Adds the last right value at or before each left row's time.

    One pass over the sorted union inside each key's blocks of time; what a block starts
    with comes from one row a block, so a busy key is spread over its blocks.  Of right
    rows of one time the greatest value counts.
    """
    a = left.withColumns({"side__": F.lit(1), "v__": F.lit(None).cast(right.schema[value].dataType)})
    b = right.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).select(*by, time, F.lit(0).alias("side__"), F.col(value).alias("v__"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("b__", F.date_trunc(block, time))
    ends = both.groupBy(*by, "b__").agg(F.max(F.when(F.col("side__") == 0, F.struct(F.col(time).alias("t"), "v__"))).alias("e__"))
    carried = ends.select(*by, "b__", F.last("e__", ignorenulls=True).over(Window.partitionBy(*by).orderBy("b__").rowsBetween(Window.unboundedPreceding, -1))["v__"].alias("c__"))
    w = Window.partitionBy(*by, "b__").orderBy(time, "side__", "v__").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("s__", F.last("v__", ignorenulls=True).over(w)).filter("side__ = 1")
    return join_groups(seen, carried, [*by, "b__"]).select(*left.columns, F.when(F.col(time).isNotNull(), F.coalesce("s__", "c__")).alias("matched"))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by crossings of a ray."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def in_any_box(points: DataFrame, boxes: DataFrame, x: str, y: str) -> DataFrame:
    """Points that lie in one of the boxes (x0, x1, y0, y1), edges included.

    A box is filed in cells of its own size, rounded up to a power of two in each
    direction, so it takes four cells at most, and a point meets the boxes of its
    cells and not all of them.  Points look in each pair of sizes that occurs.
    """
    level = lambda lo, hi: F.greatest(F.lit(-60), F.least(F.lit(1000), F.ceil(F.log2(F.greatest(F.col(hi) - F.col(lo), F.lit(2.0**-60)))))).cast("int")
    cell = lambda c, size: F.floor(c / F.pow(F.lit(2.0), size))
    covered = lambda lo, hi, size: F.explode(F.sequence(cell(F.col(lo), F.col(size)), cell(F.col(hi), F.col(size))))
    sized = boxes.filter("x0 <= x1 AND y0 <= y1").select("x0", "x1", "y0", "y1", level("x0", "x1").alias("lx__"), level("y0", "y1").alias("ly__"))
    filed = sized.select("*", covered("x0", "x1", "lx__").alias("cx__")).select("*", covered("y0", "y1", "ly__").alias("cy__"))
    # sizes are powers of two between the least and the largest double, so pairs of them are few
    sizes = F.broadcast(sized.select("lx__", "ly__").distinct())
    px, py = F.col("px__"), F.col("py__")
    at = points.select(F.col(x).alias("px__"), F.col(y).alias("py__")).filter(px.isNotNull() & py.isNotNull()).distinct()
    looked = at.crossJoin(sizes).withColumns({"cx__": cell(px, F.col("lx__")), "cy__": cell(py, F.col("ly__"))})
    inside = (px >= F.col("x0")) & (px <= F.col("x1")) & (py >= F.col("y0")) & (py <= F.col("y1"))
    hits = looked.join(filed, ["lx__", "ly__", "cx__", "cy__"]).filter(inside).select("px__", "py__").distinct()
    return points.join(hits, (points[x] == hits["px__"]) & (points[y] == hits["py__"]), "left_semi")


def in_layers(points: DataFrame, layers: DataFrame, by: list[str], height: str, lower: str, upper: str) -> DataFrame:
    """Pairs each point with the layer of its own column (``by``: time step and cell) that holds its height; lower edges included.

    Edges may move with time and place.  A layer is filed in steps of its own thickness,
    rounded up to a power of two, two at most; a point looks up its step at each
    thickness that occurs, and one test follows.  Points in no layer stay, with nulls;
    columns of layers besides ``by`` are added.
    """
    low, high = F.least(lower, upper).cast("double"), F.greatest(lower, upper).cast("double")
    added = [c for c in layers.columns if c not in by]
    sized = layers.select(*by, F.struct(*added).alias("layer__"), low.alias("low__"), high.alias("high__")).filter("low__ < high__")
    sized = sized.withColumn("l__", F.ceil(F.log2(F.col("high__") - F.col("low__"))).cast("int"))
    step = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("l__")))
    filed = sized.withColumn("s__", F.explode(F.sequence(step(F.col("low__")), step(F.col("high__")))))
    # powers of two between the least and the largest double: few, whatever the data
    sizes = F.broadcast(sized.select("l__").distinct().agg(F.collect_list("l__").alias("ls__")))
    at = points.select(*by, F.col(height).cast("double").alias("z__")).filter("z__ IS NOT NULL").distinct()
    looked = at.crossJoin(sizes).withColumn("l__", F.explode("ls__")).drop("ls__").withColumn("s__", step(F.col("z__")))
    hits = looked.join(filed, [*by, "l__", "s__"]).filter("z__ >= low__ AND z__ < high__").groupBy(*by, "z__").agg(F.min("layer__").alias("layer__"))
    clash = {c: f"{c}_layer" for c in added if c in points.columns}
    out = points.withColumn("z__", F.col(height).cast("double")).join(hits, [*by, "z__"], "left")
    return out.select(*points.columns, *[F.col(f"layer__.`{c}`").alias(clash.get(c, c)) for c in added])


def ll2ij(df: DataFrame, x: Column, y: Column, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int, clean: str = "mask") -> DataFrame:
    """Adds i and j of the grid cell of projected coordinates; outside NULL, or the nearest cell with ``clean='clip'``."""

    def cell(c: Column, start: float, step: float, n: int) -> Column:
        k = F.floor((c - start) / step).cast("int")
        return F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)) if clean == "clip" else F.when((k >= 0) & (k < n), k)

    return df.withColumns({"i": cell(x, x0, dx, nx), "j": cell(y, y0, dy, ny)})


def _up_to(axis: Column, v: Column) -> Column:
    return F.filter(axis, lambda x: x <= v)


def bilinear(points: DataFrame, grid: DataFrame, xy: tuple[str, str], axes: tuple[tuple[str, list[float]], tuple[str, list[float]]], value: str, name: str = "matched") -> DataFrame:
    """Adds a grid's value between its four cells around each point; outside the axes NULL.

    Each axis is an index column and its ascending coordinates.  A point meets its corners
    by equality of their indexes; a masked corner with a share makes the result masked.
    """
    own = points.select(*xy).distinct()
    work, weights, index = _corners(own, xy, axes)
    work = work.withColumn("w__", weights[0][0] * weights[1][0]).filter("w__ > 0 OR (w__ IS NULL AND corner__.a = 0 AND corner__.b = 0)")
    g = grid.select(*[F.col(i).alias(f"{i}__c") for i in index], F.col(value).cast("double").alias("g__"))
    both = work.join(g, [f"{i}__c" for i in index], "left").groupBy(*xy)
    whole = F.count_if(F.col("g__").isNull() | F.col("w__").isNull()) == 0
    found = both.agg(F.when(whole, F.sum(F.col("w__") * F.col("g__"))).alias(name))
    return points.join(found, list(xy), "left").select(*points.columns, name)


def _corners(points: DataFrame, xy: tuple[str, str], axes: tuple[tuple[str, list[float]], tuple[str, list[float]]]) -> tuple[DataFrame, list[tuple[Column, Column]], list[str]]:
    """A row for each point and corner of its cell, and for each axis a corner's share of the value and of the curvature; outside the axes NULL."""
    work = points.withColumn("corner__", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])))
    weights, index = [], []
    for c, (i, coord), bit in zip(xy, axes, ("a", "b"), strict=True):
        axis, n, v = F.array(*[F.lit(float(x)) for x in coord]), len(coord), F.col(c).cast("double")
        k = F.least(F.size(_up_to(axis, v)) - 1, F.lit(max(n - 2, 0)))
        h = F.get(axis, k + 1) - F.get(axis, k)
        t = F.when((v >= float(coord[0])) & (v <= float(coord[-1])), F.coalesce(F.try_divide(v - F.get(axis, k), h), F.lit(0.0)))
        up = F.col(f"corner__.{bit}") == 1
        work = work.withColumn(f"{i}__c", (k + F.col(f"corner__.{bit}")).cast("int"))
        share = F.when(up, t).otherwise(1 - t)
        weights.append((share, (share * share * share - share) * h * h / 6))
        index.append(i)
    return work, weights, index


def bicubic(points: DataFrame, ds: Dataset, value: str, xy: tuple[str, str], axes: dict[str, list[float]], name: str = "matched") -> DataFrame:
    """Adds to points the value of a cubic spline through a variable's cells; outside the axes and near masked cells NULL.

    ``axes``: the two dimensions that ``xy`` run along, with their ascending coordinates.
    Index columns of other dimensions that the points have choose the plane.  Second
    derivatives are weighted sums along each dimension (two aggregations for all
    planes); then a point meets the four corners of its cell by equality.
    """
    key = ds.vars[value].dims
    rest = [idx(d) for d in key if d not in axes]
    if missing := [i for i in rest if i not in points.columns]:
        raise ValueError(f"points need {missing}")
    df = ds.frames[key].select(*[idx(d) for d in key], F.col(value).cast("double").alias("f__"))
    names = ["f__"]
    for d, coord in axes.items():
        bent = {(i, j): w for i, j, w in curvature_weights(coord)}
        rows = [(i, j, float(i == j), bent.get((i, j), 0.0)) for i, j in sorted({*bent, *((k, k) for k in range(len(coord)))})]
        # some 60 rows a place of the axis, which is the caller's list
        table = F.broadcast(ds.spark.createDataFrame(rows, f"{idx(d)} int, new__ int, same__ double, bent__ double"))
        whole = lambda v: F.count_if(F.col(v).isNull()) == 0  # noqa: E731  a masked cell bends all that it has a weight in
        sums = [F.when(whole(v), F.sum(F.col(v) * F.col(w))).alias(f"{v}{w[0]}") for v in names for w in ("same__", "bent__")]
        others = [idx(x) for x in key if x != d]
        df = df.join(table, idx(d)).groupBy(*others, "new__").agg(*sums).withColumnRenamed("new__", idx(d))
        names = [f"{v}{w}" for v in names for w in "sb"]
    own = points.select(*rest, *xy).distinct()
    work, weights, index = _corners(own, xy, tuple((idx(d), c) for d, c in axes.items()))
    work = work.withColumns({f"w{a}{b}__": weights[0]["sb".index(a)] * weights[1]["sb".index(b)] for a in "sb" for b in "sb"})
    g = df.select(*rest, *[F.col(i).alias(f"{i}__c") for i in index], *names)
    total = F.lit(0.0)
    for a in "sb":
        for b in "sb":
            total = total + F.col(f"w{a}{b}__") * F.col(f"f__{a}{b}")
    found = work.join(g, [*rest, *[f"{i}__c" for i in index]], "left").groupBy(*rest, *xy).agg(F.when(F.count_if(total.isNull()) == 0, F.sum(total)).alias(name))
    return points.join(found, [*rest, *xy], "left").select(*points.columns, name)


def unique_points(df: DataFrame, index: list[str]) -> DataFrame:
    """One row for each cell that points fall in, with their number; points in no cell go."""
    return df.dropna(subset=index).groupBy(*index).agg(F.count("*").alias("n"))


def described(df: DataFrame, number: str, tracers: DataFrame, diagnostics: DataFrame, group: str) -> DataFrame:
    """Adds name, unit and factor of a tracer: its number and the offset of its group make the key.

    Unknown groups have offset 0; unknown keys keep their number as a name and factor 1.
    """
    d = diagnostics.select(group, "offset")
    t = tracers.select(F.col("number").alias("key__"), "name", "unit", "factor")
    keyed = df.join(d, group, "left").withColumn("key__", F.col(number) + F.coalesce("offset", F.lit(0)))
    out = keyed.join(t, "key__", "left")
    return out.select(*df.columns, F.coalesce("name", F.col("key__").cast("string")).alias("name"), F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("factor", F.lit(1.0)).alias("factor"))
