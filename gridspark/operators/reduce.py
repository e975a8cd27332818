"""Reductions along dimensions, blocks and groups."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.quantiles import join_groups, medians, quantiles
from gridspark.model import Dataset, Dims, idx
from gridspark.safe import div

#: Masked cells are skipped; spreads are of the whole population.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "std": F.stddev_pop, "var": F.var_pop, "median": F.median,
    "prod": F.product, "ptp": lambda c: F.max(c) - F.min(c), "count": F.count,
    "any": lambda c: F.bool_or(c.cast("double") != 0), "all": lambda c: F.bool_and(c.cast("double") != 0),
}
#: May be folded over several dimensions at once.
ASSOCIATIVE = {"min", "max", "sum", "prod", "any", "all"}


#: Values of a group, known from its dimensions or counted, up to which percentiles are exact aggregates in one task.
SMALL = 100_000


def _others(key: Dims, gone: set[str]) -> list[str]:
    return [idx(d) for d in key if d not in gone]


def _aggregate(ds: Dataset, gone: list[str], name: str | Callable[[Column], Column]) -> Dataset:
    f = FUNCTIONS[name] if isinstance(name, str) else name

    def one(key: Dims, df: DataFrame) -> DataFrame:
        own = [d for d in gone if d in key]
        if not own:
            return df
        if name == "median" and math.prod(ds.dims[d] for d in own) > SMALL:
            others = _others(key, set(own))
            found = medians(df, {v: F.col(v) for v in ds.names(key)}, others)
            return found.withColumns({idx(d): F.lit(0) for d in own}).select(*ds.index(key), *ds.names(key))
        out = df.groupBy(*_others(key, set(own))).agg(*[f(F.col(v)).alias(v) for v in ds.names(key)])
        return out.withColumns({idx(d): F.lit(0) for d in own}).select(*ds.index(key), *ds.names(key))

    return replace(ds.map_frames(one), dims={**ds.dims, **{d: 1 for d in gone}})


def apply_along(ds: Dataset, **by: str | Callable[[Column], Column]) -> Dataset:
    """Named reductions, from the last dimension to the first; a reduced dimension keeps length 1.

    Neighbouring dimensions with one associative function share an aggregation.
    """
    order = [d for d in reversed(ds.dims) if d in by]
    out, i = ds, 0
    while i < len(order):
        own = [order[i]]
        while i + len(own) < len(order) and by[order[i + len(own)]] == by[own[0]] and by[own[0]] in ASSOCIATIVE:
            own.append(order[i + len(own)])
        out = _aggregate(out, own, by[own[0]])
        i += len(own)
    return out


def _fibre(f: Callable, names: list[str], other: list[str], cols: list[str], index: str, length: int):
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(index)
        out = pd.DataFrame({v: np.asarray(f(rows[v].to_numpy(dtype=float)), dtype=float) for v in names})
        for o in other:
            out[o] = rows[o].iloc[0]
        out[index] = range(length)
        return out[[*cols, *names]]

    return run


def apply_fibres(ds: Dataset, dim: str, f: Callable, length: int) -> Dataset:
    """Any function of one fibre (a 1-d array in index order) to ``length`` values; runs in Python, a group a fibre."""
    frames = {}
    for key, df in ds.frames.items():
        if dim not in key:
            frames[key] = df
            continue
        names, other = ds.names(key), _others(key, {dim})
        schema = ", ".join([*(f"{i} int" for i in ds.index(key)), *(f"`{v}` double" for v in names)])

        frames[key] = df.groupBy(*(other or [F.lit(0)])).applyInPandas(_fibre(f, names, other, ds.index(key), idx(dim), length), schema)
    return replace(ds, frames=frames, dims={**ds.dims, dim: length})


def weighted(ds: Dataset, dim: str, weight: str, normalise: str | None = None) -> Dataset:
    """sum(v w) along a dimension, divided by the sum of ``normalise`` if named."""
    key = ds.vars[weight].dims
    names = [v for v in ds.names(key) if v not in (weight, normalise)]
    sums = [(F.sum(F.col(v) * F.col(weight)) if normalise is None else div(F.sum(F.col(v) * F.col(weight)), F.sum(normalise))).alias(v) for v in names]
    df = ds.frames[key].groupBy(*_others(key, {dim})).agg(*sums).withColumn(idx(dim), F.lit(0)).select(*ds.index(key), *names)
    units = ds.vars[weight].attrs.get("units")
    kept = {v: replace(ds.vars[v], attrs={**ds.vars[v].attrs, "units": f"{ds.vars[v].attrs['units']} {units}"} if normalise is None and units and "units" in ds.vars[v].attrs else ds.vars[v].attrs) for v in names}
    return replace(ds, vars=kept, frames={key: df}, dims={**ds.dims, dim: 1})


def coarsen(ds: Dataset, dim: str, factor: int, name: str) -> Dataset:
    """Blocks of ``factor`` cells along a dimension become one; a rest at the end makes a block too."""

    def one(key: Dims, df: DataFrame) -> DataFrame:
        if dim not in key:
            return df
        block = F.floor(F.col(idx(dim)) / factor).cast("int").alias(idx(dim))
        return df.groupBy(*_others(key, {dim}), block).agg(*[FUNCTIONS[name](F.col(v)).alias(v) for v in ds.names(key)]).select(*ds.index(key), *ds.names(key))

    return replace(ds.map_frames(one), dims={**ds.dims, dim: -(-ds.dims[dim] // factor)})


def refine(ds: Dataset, dim: str, factor: int) -> Dataset:
    """Each cell becomes ``factor`` cells of its value."""
    part = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("part__")

    def one(key: Dims, df: DataFrame) -> DataFrame:
        return df.select("*", part).withColumn(idx(dim), (F.col(idx(dim)) * factor + F.col("part__")).cast("int")).drop("part__") if dim in key else df

    return replace(ds.map_frames(one), dims={**ds.dims, dim: ds.dims[dim] * factor})


def day_blocks(ds: Dataset, dim: str, name: str, hours: int = 24) -> Dataset:
    """Statistics of the complete blocks of 24 cells."""
    days = ds.dims[dim] // hours
    from gridspark.operators.select import slice_dims

    return coarsen(slice_dims(ds, **{dim: slice(0, days * hours)}), dim, hours, name)


def running_mean(ds: Dataset, dim: str, width: int, least: int) -> Dataset:
    """The mean of each cell and the width - 1 after it; masked with fewer than ``least`` valid ones.  Needs a dense group."""
    from gridspark.operators.window import in_blocks


    def one(key: Dims, df: DataFrame) -> DataFrame:
        if dim not in key:
            return df
        rows, w, own = in_blocks(df, _others(key, {dim}), dim, ds.dims[dim], ahead=width - 1)
        w = w.rowsBetween(0, width - 1)
        cols = [F.when(F.count(v).over(w) >= least, F.avg(v).over(w)).alias(v) for v in ds.names(key)]
        return rows.select(*ds.index(key), own.alias("own__"), *cols).filter(F.col("own__") & (F.col(idx(dim)) <= ds.dims[dim] - width)).drop("own__")

    return replace(ds.map_frames(one), dims={**ds.dims, dim: ds.dims[dim] - width + 1})


def mda8(ds: Dataset, dim: str) -> Dataset:
    """The daily maximum of the running eight-hour mean, of which six hours at least must be valid."""
    return day_blocks(running_mean(ds, dim, 8, 6), dim, "max")


def group_stats(df: DataFrame, by: list[str | Column], value: str, percents: tuple[float, ...] = ()) -> DataFrame:
    """min, mean, max and exact percentiles of a column; what diurnal cycles and profiles are drawn from."""
    rows = df.select(*by, F.col(value).alias("value__"))
    keys = [c for c in rows.columns if c != "value__"]
    v = F.col("value__")
    out = rows.groupBy(*keys).agg(F.min(v).alias("v_min"), F.avg(v).alias("v_mean"), F.max(v).alias("v_max"), F.count(v).alias("n"))
    if percents and rows.count() <= SMALL:
        exact = F.array(*[F.percentile(v, F.lit(p)) for p in percents])
        out = rows.groupBy(*keys).agg(F.min(v).alias("v_min"), F.avg(v).alias("v_mean"), F.max(v).alias("v_max"), F.count(v).alias("n"), exact.alias("q__"))
    elif percents:
        out = join_groups(out, quantiles(rows, {"q__": v}, list(percents), keys), keys)
    return out.select(*keys, "v_min", "v_mean", "v_max", "n", *[F.col("q__")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(percents)])


def tagged_sums(df: DataFrame, keys: list[str], value: str, always: list[str]) -> DataFrame:
    """Sums by every combination of tags, where '' stands for all; ``always`` are never summed over."""
    free = [k for k in keys if k not in always]
    rolled = df.cube(*always, *free).agg(F.sum(value).alias(value), *[F.grouping(k).alias(f"{k}__g") for k in keys])
    if always:
        rolled = rolled.filter(fold(lambda a, b: a & b, [F.col(f"{k}__g") == 0 for k in always]))
    return rolled.select(*[F.when(F.col(f"{k}__g") == 1, F.lit("")).otherwise(F.col(k).cast("string")).alias(k) for k in keys], value)


def quantile_pairs(a: DataFrame, b: DataFrame, value: str, points: list[float]) -> DataFrame:
    """Quantiles of two samples side by side."""
    both = quantiles(a, {"qa": F.col(value)}, points).crossJoin(quantiles(b, {"qb": F.col(value)}, points))
    return both.select(F.posexplode(F.arrays_zip("qa", "qb")).alias("i", "q")).select("i", "q.qa", "q.qb")


def wind_rose(df: DataFrame, direction: str, speed: str, bins: int, bounds: list[float]) -> DataFrame:
    """By direction bin: the share (of all rows, in percent) with a speed below each bound."""
    width = 360.0 / bins
    sector = F.floor(F.pmod(F.col(direction) + width / 2, F.lit(360.0)) / width).cast("int").alias("sector")
    total = df.agg(F.count("*").alias("n_all"))
    counted = df.groupBy(sector).agg(*[F.count_if(F.col(speed) < b).alias(f"c{i}") for i, b in enumerate(bounds)])
    return counted.crossJoin(F.broadcast(total)).select("sector", *[(F.col(f"c{i}") * 100.0 / F.col("n_all")).alias(f"below_{i}") for i in range(len(bounds))])


def bounds_along(ds: Dataset, dim: str, low: str, high: str, factor: int | None = None) -> Dataset:
    """Bounds of merged cells: the least of the lower and the greatest of the upper ones, over all cells or blocks of ``factor``."""
    key = ds.vars[low].dims
    n = factor or ds.dims[dim]
    block = F.floor(F.col(idx(dim)) / n).cast("int").alias(idx(dim))
    df = ds.frames[key].groupBy(*_others(key, {dim}), block).agg(F.min(F.least(low, high)).alias(low), F.max(F.greatest(low, high)).alias(high))
    return replace(ds, vars={v: ds.vars[v] for v in (low, high)}, frames={key: df.select(*ds.index(key), low, high)}, dims={**ds.dims, dim: -(-ds.dims[dim] // n)}, coords=ds.coords & {low, high})
