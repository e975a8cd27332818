"""Neighbourhood operators along one dimension; they need dense groups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridspark.model import Dataset, Dims, idx
from gridspark.operators.reduce import _others
from gridspark.operators.select import slice_dims


#: Cells of a block: a longer dimension is cut, so that no task ever holds all of it.
BLOCK = 1 << 16


def in_blocks(df: DataFrame, others: list[str], dim: str, n: int, back: int = 0, ahead: int = 0) -> tuple[DataFrame, WindowSpec, Column]:
    """Rows, a window along a dimension of ``n`` cells, and which rows are the block's own.

    A long dimension is cut in blocks of BLOCK cells.  What looks ``back`` and ``ahead``
    so many cells finds copies of them at the edges of its block; only own rows
    have right values.
    """
    if n <= BLOCK:
        return df, Window.partitionBy(*others).orderBy(idx(dim)), F.lit(True)
    i = F.col(idx(dim))
    block = lambda c: F.greatest(F.lit(0), F.least(F.lit((n - 1) // BLOCK), F.floor(c / BLOCK).cast("int")))
    copied = df.withColumn("block__", F.explode(F.sequence(block(i - ahead), block(i + back))))
    return copied, Window.partitionBy(*others, "block__").orderBy(idx(dim)), F.col("block__") == block(i)


def _each(ds: Dataset, dim: str, f, length: int, keep: Column | None = None, shift: int = 0, back: int = 0, ahead: int = 0) -> Dataset:
    def one(key: Dims, df: DataFrame) -> DataFrame:
        if dim not in key:
            return df
        rows, w, own = in_blocks(df, _others(key, {dim}), dim, ds.dims[dim], back, ahead)
        out = rows.select(*ds.index(key), own.alias("own__"), *[f(F.col(v), w).alias(v) for v in ds.names(key)]).filter("own__").drop("own__")
        if keep is not None:
            out = out.filter(keep)
        return out.withColumn(idx(dim), F.col(idx(dim)) - shift) if shift else out

    return replace(ds.map_frames(one), dims={**ds.dims, dim: length})


def convolve(ds: Dataset, dim: str, weights: list[float], mode: str = "valid") -> Dataset:
    """Discrete convolution (the kernel runs backwards); modes valid, same and full."""
    k, n = len(weights), ds.dims[dim]
    if mode == "valid":
        f = lambda c, w: sum((F.lead(c, k - 1 - i).over(w) * x for i, x in enumerate(weights)), F.lit(0.0))
        return _each(ds, dim, f, n - k + 1, F.col(idx(dim)) <= n - k, ahead=k - 1)
    if mode == "same":
        back = (k - 1) // 2
        at = lambda c, w, j: F.coalesce((F.lead(c, j) if j >= 0 else F.lag(c, -j)).over(w), F.lit(0.0))
        return _each(ds, dim, lambda c, w: sum((at(c, w, back - i) * x for i, x in enumerate(weights)), F.lit(0.0)), n, back=k - 1 - back, ahead=back)
    if mode != "full":
        raise ValueError(f"no such mode: {mode}")
    # pad by k - 1 cells of zero behind, then look back
    padded = replace(ds, dims={**ds.dims, dim: n + k - 1})
    for key, df in ds.frames.items():
        if dim in key:
            others = df.select(*_others(key, {dim})).distinct()
            pad = others.crossJoin(ds.spark.range(n, n + k - 1).select(F.col("id").cast("int").alias(idx(dim))))
            padded = padded.with_frame(key, df.unionByName(pad.select(*ds.index(key), *[F.lit(0).cast(dict(df.dtypes)[v]).alias(v) for v in ds.names(key)])))
    f = lambda c, w: sum((F.coalesce(F.lag(c, i).over(w), F.lit(0.0)) * x for i, x in enumerate(weights)), F.lit(0.0))
    return _each(padded, dim, f, n + k - 1, back=k - 1)


def center(ds: Dataset, *dims: str, func: str = "mean") -> Dataset:
    """Means (or sums) of neighbours along each dimension in turn; one cell fewer each."""
    out = ds
    for d in dims:
        half = 2.0 if func == "mean" else 1.0
        n = out.dims[d]
        out = _each(out, d, lambda c, w, half=half: (c + F.lead(c, 1).over(w)) / half, n - 1, F.col(idx(d)) < n - 1, ahead=1)
    return out


def difference(ds: Dataset, dim: str) -> Dataset:
    """Each cell less the one before; the first stays."""
    return _each(ds, dim, lambda c, w: c - F.lag(c, 1, 0).over(w), ds.dims[dim], back=1)


def depth(ds: Dataset, dim: str) -> Dataset:
    """Layer depths from heights of upper edges."""
    return difference(ds, dim)


def steps(ds: Dataset, dim: str) -> Dataset:
    """Each interval's change: the next cell less this one."""
    n = ds.dims[dim]
    return _each(ds, dim, lambda c, w: F.lead(c, 1).over(w) - c, n - 1, F.col(idx(dim)) < n - 1, ahead=1)


def _scan(df: DataFrame, others: list[str], index: str, names: list[str], n: int) -> DataFrame:
    """Running sums along an index of ``n`` places; masked before the first value."""
    if n <= BLOCK:
        w = Window.partitionBy(*others).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({v: F.sum(v).over(w) for v in names})
    # sums of blocks are running sums themselves: each block starts with what those before it hold
    block = f"{index}_block__"
    rows = df.withColumn(block, F.floor(F.col(index) / BLOCK).cast("int")).repartition(*others, block)
    sums = rows.groupBy(*others, block).agg(*[F.sum(v).alias(v) for v in names])
    carried = _scan(sums, others, block, names, -(-n // BLOCK)).select(*others, (F.col(block) + 1).alias(block), *[F.col(v).alias(f"{v}__c") for v in names])
    w = Window.partitionBy(*others, block).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({v: F.sum(v).over(w) for v in names}).join(carried, [*others, block], "left")
    both = lambda v: F.coalesce(F.col(v) + F.col(f"{v}__c"), F.col(v), F.col(f"{v}__c"))
    return within.select(*[c for c in df.columns if c not in names], *[both(v).alias(v) for v in names])


def running_total(ds: Dataset, dim: str) -> Dataset:
    """Sums of each cell and all before it; a long dimension is summed by blocks, whose sums are carried on."""
    return ds.map_frames(lambda key, df: _scan(df, _others(key, {dim}), idx(dim), ds.names(key), ds.dims[dim]).select(*ds.index(key), *ds.names(key)) if dim in key else df)


def unpack_2d(ds: Dataset, rows: str, cols: str, name: str, first: float, scale: float) -> Dataset:
    """Delta-packed bytes to values: differences run down the first column, then along each row."""
    key = ds.vars[name].dims
    df = ds.frames[key].withColumn(name, (F.col(name).cast("double") - 127) / scale)
    rest = [idx(d) for d in key if d not in (rows, cols)]
    down = Window.partitionBy(*rest, idx(cols)).orderBy(idx(rows)).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*rest, idx(rows)).orderBy(idx(cols)).rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col(idx(cols)) == 0, F.sum(name).over(down) + first).otherwise(F.col(name))
    return ds.with_frame(key, df.withColumn(name, start).withColumn(name, F.sum(name).over(along)))


def edges(ds: Dataset, coord: str, name: str | None = None) -> Dataset:
    """Bounds (lo, hi) of a one-dimensional coordinate: midpoints, the ends extended."""
    key = ds.vars[coord].dims
    rows, w, own = in_blocks(ds.frames[key], [], key[0], ds.dims[key[0]], 1, 1)
    c = F.col(coord)
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    lo = F.coalesce((c + before) / 2, c - (after - c) / 2)
    hi = F.coalesce((c + after) / 2, c + (c - before) / 2)
    base = name or f"{coord}_bounds"
    df = rows.withColumns({f"{base}_lo": lo, f"{base}_hi": hi, "own__": own}).filter("own__").select(*ds.frames[key].columns, f"{base}_lo", f"{base}_hi")
    out = ds
    for v in (f"{base}_lo", f"{base}_hi"):
        out = out.with_var(v, key, df, ds.vars[coord].attrs)
    return out


def destagger(ds: Dataset, dim: str, name: str) -> Dataset:
    """Winds at cell edges to cell centres; the last cell keeps its own value."""
    key = ds.vars[name].dims
    c = F.col(name)
    rows, w, own = in_blocks(ds.frames[key], _others(key, {dim}), dim, ds.dims[dim], ahead=1)
    out = rows.withColumns({name: F.coalesce((c + F.lead(c).over(w)) / 2, c), "own__": own}).filter("own__")
    return ds.with_frame(key, out.select(*ds.index(key), *ds.names(key)))


def head(ds: Dataset, dim: str, n: int) -> Dataset:
    return slice_dims(ds, **{dim: slice(0, n)})


def time_edges(ds: Dataset, coord: str) -> Dataset:
    """Bounds of times: half the mean step before and after each."""
    key = ds.vars[coord].dims
    df = ds.frames[key]
    # the mean of all steps is the way from the first to the last over their number
    n = ds.dims[key[0]]
    ends = df.agg(F.min_by(coord, idx(key[0])).alias("first__"), F.max_by(coord, idx(key[0])).alias("last__"))
    half = (F.col("last__") - F.col("first__")) / (2.0 * max(n - 1, 1))
    df = df.crossJoin(F.broadcast(ends)).withColumns({f"{coord}_bounds_lo": F.col(coord) - half, f"{coord}_bounds_hi": F.col(coord) + half}).drop("first__", "last__")
    out = ds
    for v in (f"{coord}_bounds_lo", f"{coord}_bounds_hi"):
        out = out.with_var(v, key, df, ds.vars[coord].attrs)
    return out
