"""Selection and structure: subset, rename, slice, points, mask, insert, split and the like."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.model import Dataset, Dims, Var, idx
from gridspark.safe import isclose


def _keep(ds: Dataset, names: set[str]) -> Dataset:
    kept = {v: x for v, x in ds.vars.items() if v in names}
    frames = {k: ds.frames[k].select(*ds.index(k), *[v for v in kept if kept[v].dims == k]) for k in dict.fromkeys(x.dims for x in kept.values())}
    return replace(ds, vars=kept, frames=frames, coords=ds.coords & set(kept))


def subset(ds: Dataset, names: Sequence[str], exclude: bool = False, keep_coords: bool = True) -> Dataset:
    """Keeps (or drops) variables; other groups are never read."""
    chosen = set(ds.vars) - set(names) if exclude else set(names)
    return _keep(ds, chosen | (ds.coords if keep_coords else set()))


def rename_vars(ds: Dataset, names: dict[str, str]) -> Dataset:
    new = {names.get(v, v): x for v, x in ds.vars.items()}
    return replace(ds, vars=new, frames={k: df.withColumnsRenamed(names) for k, df in ds.frames.items()}, coords=frozenset(names.get(c, c) for c in ds.coords))


def rename_dims(ds: Dataset, names: dict[str, str]) -> Dataset:
    to = lambda k: tuple(names.get(d, d) for d in k)
    frames = {to(k): df.withColumnsRenamed({idx(a): idx(b) for a, b in names.items()}) for k, df in ds.frames.items()}
    return replace(ds, dims={names.get(d, d): n for d, n in ds.dims.items()}, vars={v: replace(x, dims=to(x.dims)) for v, x in ds.vars.items()}, frames=frames)


def mangle(ds: Dataset) -> Dataset:
    """Names that an expression can hold."""
    plain = lambda n: n.replace("-", "_").replace("$", "S").replace(" ", "_").replace("+", "_add_").replace("(", "").replace(")", "")
    return rename_vars(ds, {v: plain(v) for v in ds.vars if plain(v) != v})


def _set_len(ds: Dataset, dim: str, n: int) -> Dataset:
    return replace(ds, dims={**ds.dims, dim: n})


def slice_dims(ds: Dataset, new_dim: str = "POINTS", **by: int | slice | Sequence[int]) -> Dataset:
    """An orthogonal slice.  Two or more lists select points together, along ``new_dim``."""
    lists = {d: list(v) for d, v in by.items() if not isinstance(v, (int, slice))}
    if len(lists) > 1:
        out = slice_dims(ds, **{d: v for d, v in by.items() if d not in lists}) if len(lists) < len(by) else ds
        return select_points(out, new_dim, **lists)
    out = ds
    for d, v in by.items():
        n = ds.dims[d]
        c = F.col(idx(d))
        if isinstance(v, int):
            k = v + n if v < 0 else v
            out = _set_len(out.map_frames(lambda key, df, d=d, k=k: df.filter(F.col(idx(d)) == k).withColumn(idx(d), F.lit(0)) if d in key else df), d, 1)
        elif isinstance(v, slice):
            start, stop, step = v.indices(n)
            if step < 0:
                r = range(start, stop, step)
                start, stop, step = (r[-1], r[0] + 1, -step) if len(r) else (0, 0, 1)
                new = F.floor((F.lit(r[0] if len(r) else 0) - c) / step).cast("int")
            else:
                new = F.floor((c - start) / step).cast("int")
            cond = (c >= start) & (c < stop) & (F.pmod(c - start, F.lit(step)) == 0)
            out = _set_len(out.map_frames(lambda key, df, d=d, cond=cond, new=new: df.filter(cond).withColumn(idx(d), new) if d in key else df), d, len(range(*v.indices(n))))
        else:
            out = _by_list(out, d, list(v))
    return out


def _by_list(ds: Dataset, d: str, at: list[int]) -> Dataset:
    n = ds.dims[d]
    table = ds.spark.createDataFrame([(i + n if i < 0 else i, k) for k, i in enumerate(at)], f"{idx(d)} int, new__ int")

    def pick(key: Dims, df):
        # the list comes from the caller's program, so its size is bounded
        return df.join(F.broadcast(table), idx(d)).drop(idx(d)).withColumnRenamed("new__", idx(d)) if d in key else df

    return _set_len(ds.map_frames(pick), d, len(at))


def select_points(ds: Dataset, new_dim: str, **at: Sequence[int]) -> Dataset:
    """Points together: variables with two or more of the dimensions lose them for ``new_dim``; repeats and order stay."""
    n = {len(v) for v in at.values()}
    if len(n) != 1:
        raise ValueError("lists of points must have one length")
    rows = [tuple([k, *(int(v[k]) + (ds.dims[d] if v[k] < 0 else 0) for d, v in at.items())]) for k in range(n.pop())]
    table = F.broadcast(ds.spark.createDataFrame(rows, ", ".join([f"{idx(new_dim)} int", *(f"{idx(d)} int" for d in at)])))
    out, dims, new_vars, frames = ds, dict(ds.dims), {}, {}
    for key, df in ds.frames.items():
        own = [d for d in key if d in at]
        if len(own) >= 2:
            some = table.select(idx(new_dim), *[idx(d) for d in own])
            rest = tuple([*[d for d in key if d not in own and key.index(d) < key.index(own[0])], new_dim, *[d for d in key if d not in own and key.index(d) > key.index(own[0])]])
            frames[rest] = df.join(some, [idx(d) for d in own]).select(*[idx(d) for d in rest], *ds.names(key))
            new_vars |= {v: replace(ds.vars[v], dims=rest) for v in ds.names(key)}
        elif own:
            frames[key] = _by_list(replace(ds, frames={key: df}), own[0], list(at[own[0]])).frames[key]
            new_vars |= {v: ds.vars[v] for v in ds.names(key)}
        else:
            frames[key] = df
            new_vars |= {v: ds.vars[v] for v in ds.names(key)}
    dims |= {d: len(rows) for d in at} | {new_dim: len(rows)}
    return replace(out, dims=dims, vars={v: new_vars[v] for v in ds.vars}, frames=frames)


def slice_text(ds: Dataset, text: str) -> Dataset:
    """``dim,start[,stop[,stride]]``; also dims named so with digits behind."""
    name, *rest = text.split(",")
    nums = [int(x) if x not in ("", "None") else None for x in rest]
    by = nums[0] if len(nums) == 1 else slice(*nums)
    out = ds
    for d in ds.dims:
        if d == name or re.fullmatch(re.escape(name) + r"\d+", d):
            out = slice_dims(out, **{d: by})
    return out.set_attrs(history=f"{ds.attrs.get('history', '')}slice {text};")


def mask(ds: Dataset, where: Column | None = None, less: float | None = None, less_equal: float | None = None, greater: float | None = None, greater_equal: float | None = None, values: float | None = None, equal: float | None = None, invalid: bool = False, coords: bool = False) -> Dataset:
    """Masks cells that meet any of the conditions, which add up in this order."""

    def one(c: Column) -> Column:
        for cond in (
            where,
            None if less is None else c < less,
            None if less_equal is None else c <= less_equal,
            None if greater is None else c > greater,
            None if greater_equal is None else c >= greater_equal,
            None if values is None else isclose(c, values),
            None if equal is None else c == equal,
            F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")) if invalid else None,
        ):
            if cond is not None:
                c = F.when(cond, F.lit(None)).otherwise(c)
        return c

    def every(key: Dims, df):
        return df.select(*ds.index(key), *[(one(F.col(v)) if coords or v not in ds.coords else F.col(v)).alias(v) for v in ds.names(key)])

    return ds.map_frames(every)


def insert_dim(ds: Dataset, before: str | None = None, after: str | None = None, **new: int) -> Dataset:
    """Adds a dimension to every variable (that has the anchor, if one is named); a length over 1 repeats the data."""
    out = ds
    for d, n in new.items():
        grid = F.broadcast(ds.spark.range(n).select(F.col("id").cast("int").alias(idx(d))))
        frames, new_vars = {}, {}
        for key, df in out.frames.items():
            anchor = before or after
            if anchor and anchor not in key or d in key:
                to = key
                frames[to] = df
            else:
                at = key.index(before) if before else key.index(after) + 1 if after else 0
                to = (*key[:at], d, *key[at:])
                frames[to] = df.withColumn(idx(d), F.lit(0)) if n == 1 else df.crossJoin(grid)
            new_vars |= {v: replace(out.vars[v], dims=to) for v in out.names(key)}
        out = replace(out, dims={**out.dims, d: n}, vars={v: new_vars[v] for v in out.vars}, frames=frames)
    return out


def reorder(ds: Dataset, order: Sequence[str]) -> Dataset:
    """Permutes dimensions; only the driver's record changes."""
    to = lambda k: tuple([d for d in order if d in k] + [d for d in k if d not in order])
    return replace(ds, vars={v: replace(x, dims=to(x.dims)) for v, x in ds.vars.items()}, frames={to(k): df for k, df in ds.frames.items()})


def remove_singleton(ds: Dataset, dim: str | None = None) -> Dataset:
    """Drops dimensions of length 1 (all, or the one named)."""
    gone = [d for d, n in ds.dims.items() if n == 1 and dim in (None, d)]
    out = ds
    for d in gone:
        frames, new_vars = {}, {}
        for key, df in out.frames.items():
            to = tuple(x for x in key if x != d)
            some = df.drop(idx(d))
            if to in frames:
                some = frames[to].join(some, [idx(x) for x in to], "full") if to else frames[to].crossJoin(some)
            frames[to] = some
            new_vars |= {v: replace(out.vars[v], dims=to) for v in out.names(key)}
        out = replace(out, dims={x: n for x, n in out.dims.items() if x != d}, vars={v: new_vars[v] for v in out.vars}, frames=frames)
    return out


def split_dim(ds: Dataset, old: str, new: dict[str, int]) -> Dataset:
    """One dimension into many, the last running fastest."""
    total = 1
    for n in new.values():
        total *= n
    if total != ds.dims[old]:
        raise ValueError(f"{old} has {ds.dims[old]} cells, not {total}")
    frames, new_vars = {}, {}
    for key, df in ds.frames.items():
        to = tuple(x for d in key for x in (new if d == old else (d,)))
        if old in key:
            cols, rest = {}, total
            for d, n in new.items():
                rest //= n
                cols[idx(d)] = F.floor(F.col(idx(old)) / rest).cast("int") % n
            df = df.withColumns(cols).drop(idx(old))
        frames[to] = df
        new_vars |= {v: replace(ds.vars[v], dims=to) for v in ds.names(key)}
    dims = {}
    for d, n in ds.dims.items():
        dims |= new if d == old else {d: n}
    return replace(ds, dims=dims, vars={v: new_vars[v] for v in ds.vars}, frames=frames)


def copy_var(ds: Dataset, name: str, new: str) -> Dataset:
    key = ds.vars[name].dims
    return ds.with_var(new, key, ds.frames[key].withColumn(new, F.col(name)), ds.vars[name].attrs)


def new_var(ds: Dataset, name: str, value: Column, like: str, **attrs: object) -> Dataset:
    """A variable computed from those of one group."""
    key = ds.vars[like].dims
    return replace(ds.with_frame(key, ds.frames[key].withColumn(name, value)), vars={**ds.vars, name: Var(key, {**ds.vars[like].attrs, **attrs})})


_MASKS = {"less": "less", "less_equal": "less_equal", "greater": "greater", "greater_equal": "greater_equal", "values": "values", "equal": "equal"}


def mask_text(ds: Dataset, text: str) -> Dataset:
    """``type,number``: less, less_equal, greater, greater_equal, equal, not_equal, values, invalid; ``inside,a,b`` and
    ``outside,a,b`` with their ends inside; or ``where,expression`` over the variables of a group.

    Coordinates stay as they are.  An expression masks the groups that have all of its variables.
    """
    kind, _, rest = text.partition(",")
    if kind == "where":
        from gridspark.functions.expr import condition

        frames = {}
        for key, df in ds.frames.items():
            c = condition(ds, rest, key)
            frames[key] = df if c is None else mask(replace(ds, frames={key: df}), where=c).frames[key]
        return replace(ds, frames=frames)
    if kind == "invalid":
        return mask(ds, invalid=True)
    if kind in _MASKS:
        return mask(ds, **{_MASKS[kind]: float(rest)})
    tests = {"not_equal": lambda c, a: c != a, "inside": lambda c, a, b: c.between(min(a, b), max(a, b)), "outside": lambda c, a, b: ~c.between(min(a, b), max(a, b))}
    if kind not in tests:
        raise ValueError(f"no such mask: {kind}")
    at = [float(x) for x in rest.split(",")]
    return ds.map_frames(lambda key, df: df.select(*ds.index(key), *[(F.col(v) if v in ds.coords else F.when(tests[kind](F.col(v), *at), F.lit(None)).otherwise(F.col(v))).alias(v) for v in ds.names(key)]))


def window_from(ds: Dataset, other: dict, x: str = "COL", y: str = "ROW") -> Dataset:
    """The cells that another grid's box covers; both grids give XORIG, YORIG, XCELL and YCELL, the other NCOLS and NROWS.

    Cells of the box's edge that stand only partly in it are left out.
    """
    out = ds
    for d, start, cell, n in ((x, "XORIG", "XCELL", "NCOLS"), (y, "YORIG", "YCELL", "NROWS")):
        own, step = float(ds.attrs[start]), float(ds.attrs[cell])
        lo = math.ceil(round((float(other[start]) - own) / step, 9))
        hi = math.floor(round((float(other[start]) + float(other[cell]) * int(other[n]) - own) / step, 9))
        lo, hi = max(lo, 0), min(max(hi, 0), ds.dims[d])
        out = slice_dims(out, **{d: slice(lo, max(lo, hi))}).set_attrs(**{start: own + lo * step, n: max(hi - lo, 0)})
    return out


def flagged(df: DataFrame, flag: str, good: Sequence[str]) -> DataFrame:
    """Rows whose quality flag is one of the good ones; rows without a flag go."""
    return df.filter(F.col(flag).isin(*good))
