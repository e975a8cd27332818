"""Interpolation and regridding by sparse weight tables."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.model import Dataset, idx
from gridspark.operators.reduce import _others
from gridspark.safe import div

Weights = list[tuple[int, int, float]]


def linear_weights(old: list[float], new: list[float], extrapolate: bool = False) -> Weights:
    """(old, new, weight) of linear interpolation; beyond the ends the end's value, or the end segment's line."""
    x = np.asarray(old, dtype=float)
    order = np.argsort(x, kind="stable")
    xs = x[order]
    out: Weights = []
    for j, v in enumerate(np.asarray(new, dtype=float)):
        if len(xs) == 1:
            out.append((0, j, 1.0))
            continue
        k = int(np.clip(np.searchsorted(xs, v, side="right") - 1, 0, len(xs) - 2))
        t = (v - xs[k]) / (xs[k + 1] - xs[k])
        if not extrapolate:
            t = min(max(t, 0.0), 1.0)
        out += [(int(order[k + i]), j, float(w)) for i, w in ((0, 1 - t), (1, t)) if w]
    return out


def overlap_weights(old_edges: list[float], new_edges: list[float]) -> Weights:
    """Of each new layer the share that each old layer fills, by thickness: conserves mass."""
    out: Weights = []
    for j in range(len(new_edges) - 1):
        lo, hi = sorted(new_edges[j : j + 2])
        parts = []
        for i in range(len(old_edges) - 1):
            a, b = sorted(old_edges[i : i + 2])
            if (w := min(hi, b) - max(lo, a)) > 0:
                parts.append((i, w))
        total = sum(w for _, w in parts)
        out += [(i, j, w / total) for i, w in parts]
    return out


def curvature_weights(coord: list[float]) -> Weights:
    """(value, place, weight): the second derivatives of a cubic spline at its nodes as sums of its values.

    The first and the last two pieces are one cubic each, so a cubic is met exactly.  A
    value's weight falls by about 3.7 with each node away; those that a double doesn't
    show beside the greatest are left out, so a long axis has some 60 a node.
    """
    x = np.asarray(coord, dtype=float)
    n, h = len(x), np.diff(x)
    if (h <= 0).any():
        raise ValueError("coordinates must ascend")
    if n < 3:
        return []
    # unknowns are the inner nodes; the ends follow from their neighbours
    right = np.zeros((n - 2, n))
    for i in range(1, n - 1):
        right[i - 1, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    main, over, under = 2 * (h[:-1] + h[1:]), h[1:-1].copy(), h[1:-1].copy()
    if n == 3:  # a parabola
        w = np.repeat(right / (3 * (h[0] + h[1])), 3, axis=0)
    else:
        first, last = (h[0] + h[1]) / h[1], (h[-1] + h[-2]) / h[-2]
        main[0] += h[0] * first
        over[0] -= h[0] ** 2 / h[1]
        main[-1] += h[-1] * last
        under[-1] -= h[-1] ** 2 / h[-2]
        for i in range(1, n - 2):  # forward, then back, all values at once
            f = under[i - 1] / main[i - 1]
            main[i] -= f * over[i - 1]
            right[i] -= f * right[i - 1]
        right[-1] /= main[-1]
        for i in range(n - 4, -1, -1):
            right[i] = (right[i] - over[i] * right[i + 1]) / main[i]
        w = np.vstack([first * right[0] - h[0] / h[1] * right[1], right, last * right[-1] - h[-1] / h[-2] * right[-2]])
    keep = np.abs(w) > 1e-17 * np.abs(w).max(axis=1, keepdims=True)
    return [(int(i), int(j), float(w[j, i])) for j, i in zip(*np.nonzero(keep), strict=True)]


def apply_weights(ds: Dataset, dim: str, weights: Weights, length: int, log: bool = False) -> Dataset:
    """new = sum of weight times old along a dimension (or the exponential of that of logarithms).

    The table has some rows a new cell and is broadcast: its size is that of the new axis.
    """
    table = F.broadcast(ds.spark.createDataFrame(weights, f"{idx(dim)} int, new__ int, w__ double"))
    frames = {}
    for key, df in ds.frames.items():
        if dim in key:
            value = (lambda v: F.exp(F.sum(F.log(v) * F.col("w__")))) if log else (lambda v: F.sum(F.col(v) * F.col("w__")))
            df = df.join(table, idx(dim)).groupBy(*_others(key, {dim}), "new__").agg(*[value(v).alias(v) for v in ds.names(key)]).withColumnRenamed("new__", idx(dim)).select(*ds.index(key), *ds.names(key))
        frames[key] = df
    return replace(ds, frames=frames, dims={**ds.dims, dim: length})


def interpolate(ds: Dataset, dim: str, coord: list[float], new: list[float], extrapolate: bool = False, log: bool = False) -> Dataset:
    return apply_weights(ds, dim, linear_weights(coord, new, extrapolate), len(new), log)


def interpolate_columns(df: DataFrame, by: list[str], coord: str, values: list[str], new: DataFrame, target: str) -> DataFrame:
    """Linear interpolation where each column of cells (``by``) has its own coordinate.

    Segments between neighbours are joined with the targets (``by``, target); ends are
    held beyond the range; a descending coordinate is as good.
    """
    w = Window.partitionBy(*by).orderBy(coord)
    nxt = [F.lead(c).over(w).alias(f"{c}__n") for c in (coord, *values)]
    seg = df.select(*by, coord, *values, *nxt, F.row_number().over(w).alias("k__"))
    first = F.col("k__") == 1
    held = (F.col(target) >= F.col(coord)) | first
    below = F.col(f"{coord}__n").isNull() | (F.col(target) < F.col(f"{coord}__n"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(div(F.col(target) - F.col(coord), F.col(f"{coord}__n") - F.col(coord)), F.lit(0.0))))
    both = new.join(seg, by).filter(held & below)
    return both.select(*new.columns, *[(F.col(v) + F.coalesce((F.col(f"{v}__n") - F.col(v)) * t, F.lit(0.0))).alias(v) for v in values])


def layer_mean(df: DataFrame, by: list[str], level: str, value: str, weight: str, edges: list[float]) -> DataFrame:
    """sum(value)/sum(weight) of the rows in each layer (from an edge down to the next, which belongs to it); empty layers are masked."""
    layers = F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(float(max(e))).alias("hi"), F.lit(float(min(e))).alias("lo")) for k, e in enumerate(zip(edges, edges[1:], strict=False))])
    all_layers = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    groups = all_layers.withColumn("layer", F.explode(F.transform(layers, lambda x: x["layer"])))
    level_ = F.col(level)
    held = F.explode(F.transform(F.filter(layers, lambda x: (level_ <= x["hi"]) & (level_ > x["lo"])), lambda x: x["layer"]))
    inside = df.withColumn("layer", held).groupBy(*by, "layer").agg(div(F.sum(value), F.sum(weight)).alias("mean"))
    return groups.select(*by, "layer").join(inside, [*by, "layer"], "left")


def column_overlaps(old: DataFrame, new: DataFrame, by: list[str], layer: str = "layer", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """By how much each old layer of a column overlaps each new one: by, old__, new__, thick__.

    Each column (``by``) has edges of its own on both sides, up or down, perhaps with
    gaps; layers of one side don't overlap.  One sweep over the merged edges of a
    column tells which layers are open between two of them, so an edge is sorted once
    and no layer is compared with another.
    """

    def ends(df: DataFrame, side: int) -> DataFrame:
        low, high = F.least(lower, upper).cast("double"), F.greatest(lower, upper).cast("double")
        at = F.explode(F.array(F.struct(low.alias("edge__"), F.col(layer).cast("int").alias("open__")), F.struct(high.alias("edge__"), F.lit(-1).alias("open__"))))
        return df.filter(low < high).select(*by, at.alias("e__")).select(*by, F.lit(side).alias("side__"), "e__.*")

    # what ends at an edge comes before what begins there
    order = Window.partitionBy(*by).orderBy("edge__", "open__")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    now = lambda side: F.last(F.when(F.col("side__") == side, F.col("open__")), ignorenulls=True).over(so_far)
    swept = ends(old, 0).unionByName(ends(new, 1)).select(*by, now(0).alias("old__"), now(1).alias("new__"), (F.lead("edge__").over(order) - F.col("edge__")).alias("thick__"))
    return swept.filter("old__ >= 0 AND new__ >= 0 AND thick__ > 0").groupBy(*by, "old__", "new__").agg(F.sum("thick__").alias("thick__"))


def remap_columns(old: DataFrame, new: DataFrame, by: list[str], values: list[str], layer: str = "layer", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Means of the old layers in each new one by thickness, where every column has its own edges; masked cells count nothing.

    Returns by, layer and values, a row for each new layer; one that no old layer reaches is masked.
    """
    shares = column_overlaps(old, new, by, layer, lower, upper)
    held = old.select(*by, F.col(layer).cast("int").alias("old__"), *values)
    sums = [div(F.sum(F.col(v) * F.col("thick__")), F.sum(F.when(F.col(v).isNotNull(), F.col("thick__")))).alias(v) for v in values]
    # merged: planners don't see how many layers a column has, and would broadcast what the driver can't hold
    means = shares.join(held.hint("merge"), [*by, "old__"]).groupBy(*by, F.col("new__").alias(layer)).agg(*sums)
    return new.select(*by, F.col(layer).cast("int").alias(layer)).join(means.hint("merge"), [*by, layer], "left")


def hybrid_at(cells: DataFrame, a: list[float], b: list[float], pressure: str, layer: str = "layer", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Cells with the edges a + b * pressure (their surface's) of their own layer; masked where there is no such layer."""
    if len(a) != len(b):
        raise ValueError("as many a as b")
    of = lambda values, k: F.get(F.array(*[F.lit(float(x)) for x in values]), k)
    edge = lambda k: of(a, k) + of(b, k) * F.col(pressure)
    k = F.when(F.col(layer).between(0, len(a) - 2), F.col(layer))
    return cells.withColumns({lower: edge(k), upper: edge(k + 1)})


def hybrid_edges(columns: DataFrame, a: list[float], b: list[float], pressure: str, layer: str = "layer", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Layers of each column between edges a + b * pressure (its surface's): a row a column and layer."""
    return hybrid_at(columns.withColumn(layer, F.explode(F.sequence(F.lit(0), F.lit(len(a) - 2)))), a, b, pressure, layer, lower, upper)


def interpolate_points(ds: Dataset, name: str, coords: dict[str, list[float]], points: dict[str, list[float]], new_dim: str = "POINTS") -> Dataset:
    """A variable of a rectangular table at points inside it, by a line along each named dimension.

    Points come from the caller's program; their weights (two a dimension and point) are broadcast.
    """
    key, dims = ds.vars[name].dims, list(coords)
    n = len(next(iter(points.values())))
    table = []
    for p in range(n):
        rows = [((), 1.0)]
        for d in dims:
            rows = [((*at, i), w * x) for at, w in rows for i, _, x in linear_weights(coords[d], [points[d][p]])]
        table += [(p, *at, w) for at, w in rows]
    weights = F.broadcast(ds.spark.createDataFrame(table, ", ".join([f"{idx(new_dim)} int", *(f"{idx(d)} int" for d in dims), "w__ double"])))
    rest = [idx(d) for d in key if d not in dims]
    df = ds.frames[key].join(weights, [idx(d) for d in dims]).groupBy(*rest, idx(new_dim)).agg(F.sum(F.col(name) * F.col("w__")).alias(name))
    to = (*[d for d in key if d not in dims], new_dim)
    left = {d: c for d, c in ds.dims.items() if d in to}
    return replace(ds, dims={**left, new_dim: n}, vars={name: replace(ds.vars[name], dims=to)}, frames={to: df}, coords=frozenset())


def interpolate_sigma(ds: Dataset, dim: str, levels: list[float], new: list[float], top: float = 10_000.0, new_top: float | None = None, kind: str = "linear", surface: float = 101_325.0) -> Dataset:
    """Layers between sigma edges to other layers: a line between middles, or shares of thickness (conserve).

    Another top makes the old edges sigmas of that top first.
    """
    if kind not in ("linear", "conserve"):
        raise ValueError(f"no such kind: {kind}")
    if new_top is not None and new_top != top:
        levels = [(s * (surface - top) + top - new_top) / (surface - new_top) for s in levels]
    middle = lambda e: [(a + b) / 2 for a, b in zip(e, e[1:], strict=False)]
    weights = linear_weights(middle(levels), middle(new)) if kind == "linear" else overlap_weights(levels, new)
    return apply_weights(ds, dim, weights, len(new) - 1).set_attrs(VGLVLS=list(new), VGTOP=top if new_top is None else new_top, NLAYS=len(new) - 1)


def eta_to_sigma(edges_hpa: list[float]) -> list[float]:
    """Sigma edges of layers given by their pressures."""
    return [(p - edges_hpa[-1]) / (edges_hpa[0] - edges_hpa[-1]) for p in edges_hpa]


def to_grid(ds: Dataset, nrows: int, ncols: int, nsteps: int = 1, layer: str = "LAY") -> Dataset:
    """A profile at each step and cell."""
    from gridspark.operators.select import insert_dim

    out = insert_dim(ds, before=layer, TSTEP=nsteps)
    return insert_dim(insert_dim(out, after=layer, ROW=nrows), after="ROW", COL=ncols)


def to_perimeter(ds: Dataset, nrows: int, ncols: int, layer: str = "LAY") -> Dataset:
    """A profile at each cell around a grid: one of four sides (south, east, north, west) for each cell.

    A variable with a SIDE dimension gives each side its own; others are repeated.
    """
    from gridspark.operators.select import insert_dim

    n = 2 * (nrows + ncols) + 4
    if "SIDE" not in ds.dims:
        return insert_dim(ds, after=layer, PERIM=n)
    bounds = [0, ncols + 1, ncols + nrows + 2, 2 * ncols + nrows + 3, n]
    cells = F.broadcast(ds.spark.createDataFrame([(s, c) for s in range(4) for c in range(bounds[s], bounds[s + 1])], f"{idx('SIDE')} int, {idx('PERIM')} int"))
    frames, kept = {}, {}
    for key, df in ds.frames.items():
        to = tuple("PERIM" if d == "SIDE" else d for d in key)
        frames[to] = df.join(cells, idx("SIDE")).select(*[idx(d) for d in to], *ds.names(key)) if "SIDE" in key else df
        kept |= {v: replace(ds.vars[v], dims=to) for v in ds.names(key)}
    return replace(ds, dims={**{d: c for d, c in ds.dims.items() if d != "SIDE"}, "PERIM": n}, vars={v: kept[v] for v in ds.vars}, frames=frames)
