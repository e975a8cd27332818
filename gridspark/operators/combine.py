"""Datasets with datasets: arithmetic, stacking, functions of variables."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.model import Dataset, idx
from gridspark.safe import div, floordiv, masked_invalid, mod, power

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": div, "//": floordiv, "%": mod, "**": power,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b),
}


def binary(op: str | Callable[[Column, Column], Column], a: Dataset, b: Dataset) -> Dataset:
    """Cell by cell on variables of one name; coordinates and variables that b lacks come from a.

    A dimension of length 1 in b is spread along a's.  Cells are joined on their index.
    """
    f = OPERATORS[op] if isinstance(op, str) else op
    sign = op if isinstance(op, str) else getattr(op, "__name__", "f")
    frames, new_vars = {}, {}
    for key, df in a.frames.items():
        both = [v for v in a.names(key) if v not in a.coords and v in b.vars and set(b.vars[v].dims) == set(key)]
        if lost := [v for v in a.names(key) if v not in a.coords and v not in both]:
            warnings.warn(f"only in the first dataset: {lost}", stacklevel=2)
        if both:
            bkey = b.vars[both[0]].dims
            on = [d for d in key if not (b.dims[d] == 1 and a.dims[d] > 1)]
            side = b.frames[bkey].select(*[idx(d) for d in on], *[F.col(v).alias(f"{v}__b") for v in both])
            joined = df.join(side, [idx(d) for d in on]) if on else df.crossJoin(F.broadcast(side))
            values = {v: f(F.col(v), F.col(f"{v}__b")) for v in both}
            df = joined.select(*a.index(key), *[(masked_invalid(values[v]) if sign in ("+", "-", "*", "/", "**") else values[v]).alias(v) if v in both else F.col(v) for v in a.names(key)])
        frames[key] = df
        for v in a.names(key):
            at = dict(a.vars[v].attrs)
            if v in both and "units" in at:
                at["units"] = f"({at['units']}) {sign} ({b.vars[v].attrs.get('units', '')})"
            new_vars[v] = replace(a.vars[v], attrs=at)
    return replace(a, frames=frames, vars={v: new_vars[v] for v in a.vars})


def sequence(ops: list[str], datasets: list[Dataset]) -> Dataset:
    """Left to right: the first two, then each next one."""
    return reduce(lambda acc, x: binary(x[0], acc, x[1]), zip(ops, datasets[1:], strict=True), datasets[0])


def apply_function(f: Callable[[Column], Column], ds: Dataset) -> Dataset:
    """A function of every variable but coordinates; invalid results are masked."""
    return ds.map_frames(lambda key, df: df.select(*ds.index(key), *[F.col(v) if v in ds.coords else masked_invalid(f(F.col(v))).alias(v) for v in ds.names(key)]))


def stack(parts: list[Dataset], dim: str) -> Dataset:
    """Along a dimension; others must agree, and variables without it come from the first."""
    first = parts[0]
    for p in parts[1:]:
        for d, n in first.dims.items():
            if d != dim and p.dims.get(d, n) != n:
                raise ValueError(f"dimension {d} has lengths {n} and {p.dims[d]}")
    frames = dict(first.frames)
    for key in first.frames:
        if dim in key:
            at, pieces = 0, []
            for p in parts:
                pieces.append(p.frames[key].select(*[(F.col(i) + at).cast("int").alias(i) if i == idx(dim) else F.col(i) for i in first.index(key)], *first.names(key)))
                at += p.dims[dim]
            frames[key] = reduce(lambda x, y: x.unionByName(y), pieces)
    return replace(first, frames=frames, dims={**first.dims, dim: sum(p.dims[dim] for p in parts)})


def merge(parts: list[Dataset]) -> Dataset:
    return reduce(lambda a, b: a.merge(b), parts)


def paired(obs: Dataset, mod: Dataset, name: str):
    """All cells of both (a full outer join on the index) with columns obs and mod."""
    key = obs.vars[name].dims
    o = obs.frames[key].select(*obs.index(key), F.col(name).cast("double").alias("obs"))
    m = mod.frames[mod.vars[name].dims].select(*obs.index(key), F.col(name).cast("double").alias("mod"))
    return o.join(m, obs.index(key), "full")


def master(parts: list[Dataset], layer: str = "LAY", surface: str = "SURFLAY") -> Dataset:
    """The first of each variable; a layer dimension of length 1 gets its own name beside a longer one."""
    from gridspark.operators.select import rename_dims

    return merge([rename_dims(p, {layer: surface}) if p.dims.get(layer) == 1 else p for p in parts])


def reaction_texts(net: DataFrame, by: list[str], species: str, value: str) -> DataFrame:
    """A line for each net reaction: what it uses <-> what it makes, species in order of their names."""
    side = lambda sign: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(value) * sign > 0, F.struct(F.col(species).alias("s"), F.abs(F.col(value).cast("double")).alias("v"))))), lambda x: F.format_string("%.6f %s", x["v"], x["s"])), " + ")
    # as many entries a reaction as there are species
    return net.groupBy(*by).agg(F.concat(side(-1), F.lit(" <-> "), side(1)).alias("reaction"))
