"""Command line: ``python -m gridspark.cli dump|gen|eval options files... [--sep options files...]...``.

``--sep`` begins a group with options of its own; ``-f`` is handed on, and with
``--inherit`` so are all options of the first group that a later one doesn't give.
Within a group, files are first worked on one by one: variables, attributes, renames,
masks, slices, reductions, coarsening, convolution, extraction, singleton removal.
Then the group's files are stacked, merged and combined by operators, and last come
scripts and expressions.  A group without files works on what all groups before it
gave.  Nothing runs before the whole line is one plan; a file that several groups name is opened once.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce as fold

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridspark.functions import expr, stats
from gridspark.model import Dataset, idx
from gridspark.operators import combine, extract, reduce, select, window
from gridspark.sources import registry

_TYPES = {"f": float, "d": float, "l": int, "s": int, "i": int, "b": int, "c": str}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridspark")
    p.add_argument("files", nargs="*")
    p.add_argument("-f", "--format")
    p.add_argument("-o", "--out")
    p.add_argument("--out-format", default=None)
    p.add_argument("-v", "--variables", action="append", default=[], help="names or expressions, with commas")
    p.add_argument("-a", "--attribute", action="append", default=[], help="name,variable (or global),mode (a c d m o),type,value")
    p.add_argument("--rename", action="append", default=[], help="v,old,new or d,old,new")
    p.add_argument("-m", "--mask", action="append", default=[], help="greater,0 or where,expression and the like")
    p.add_argument("-s", "--slice", action="append", default=[], help="dim,start[,stop[,stride]]")
    p.add_argument("-r", "--reduce", action="append", default=[], help="dim,function[,weight variable]")
    p.add_argument("--mesh", action="append", default=[], help="dim,factor,function; a factor below 1 refines")
    p.add_argument("-c", "--convolve", action="append", default=[], help="dim,mode,w1,w2,...")
    p.add_argument("-e", "--extract", action="append", default=[], help="lon,lat/lon,lat/...: the nearest cells")
    p.add_argument("--mangle", action="store_true")
    p.add_argument("--remove-singleton", action="store_true")
    p.add_argument("--stack", help="dimension")
    p.add_argument("--merge", action="store_true")
    p.add_argument("--op-typ", action="append", default=[], help="operator between files, in turn")
    p.add_argument("--exprscript", action="append", default=[], help="file of assignments")
    p.add_argument("--expr", action="append", default=[])
    p.add_argument("--funcs", default=None)
    p.add_argument("--inherit", action="store_true")
    return p


@dataclass
class Group:
    """Options of one group; ``given`` are those that stand on the line."""

    a: argparse.Namespace
    given: set[str] = field(default_factory=set)

    @staticmethod
    def parse(argv: Sequence[str]) -> Group:
        p = parser()
        a = p.parse_args(list(argv))
        return Group(a, {k for k, v in vars(a).items() if v != p.get_default(k)})


def groups(argv: Sequence[str]) -> list[Group]:
    parts: list[list[str]] = [[]]
    for x in argv:
        if x == "--sep":
            parts.append([])
        else:
            parts[-1].append(x)
    out = [Group.parse(p) for p in parts]
    for g in out[1:]:
        for k in vars(out[0].a):
            if k not in g.given and (k == "format" or out[0].a.inherit and k not in ("files", "out", "out_format", "inherit")):
                setattr(g.a, k, getattr(out[0].a, k))
    return out


def at_points(ds: Dataset, text: str) -> Dataset:
    """The cells nearest to lon,lat/lon,lat/...; variables on both coordinates' dimensions get POINTS instead."""
    points = [tuple(float(x) for x in p.split(",")) for p in text.split("/")]
    lon, lat = (next((c for c in names if c in ds.vars), None) for names in (("longitude", "lon"), ("latitude", "lat")))
    if lon is None or lat is None:
        raise ValueError("no coordinates named longitude and latitude")
    dims = tuple(dict.fromkeys([*ds.vars[lat].dims, *ds.vars[lon].dims]))
    cells = ds.frame(lat).select(*[idx(d) for d in ds.vars[lat].dims], F.col(lat).alias("lat__"))
    shared = [idx(d) for d in ds.vars[lon].dims if d in ds.vars[lat].dims]
    other = ds.frame(lon).select(*[idx(d) for d in ds.vars[lon].dims], F.col(lon).alias("lon__"))
    grid = cells.join(other, shared) if shared else cells.crossJoin(other)
    place = F.lit(0).cast("long")
    for d in dims:
        place = place * ds.dims[d] + F.col(idx(d))
    wanted = ds.spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "n__ int, lon double, lat double")
    found = extract.nearest_points(wanted, grid.select(place.alias("cell__"), F.col("lon__").alias("lon"), F.col("lat__").alias("lat")), ["n__"], "cell__")
    at: dict[str, list[int]] = {d: [] for d in dims}
    for r in found.orderBy("n__").collect():  # as many as the line names
        cell = r["cell__"]
        for d in reversed(dims):
            at[d].append(cell % ds.dims[d])
            cell //= ds.dims[d]
    return select.slice_dims(ds, "POINTS", **at)


def prepare(ds: Dataset, a: argparse.Namespace) -> Dataset:
    if a.variables:
        ds = expr.pick(ds, [v for text in a.variables for v in text.split(",")])
    for text in a.attribute:
        name, var, mode, kind, value = [*text.split(",", 4), "", ""][:5]
        ds = ds.edit_attr(name, None if var in ("", "global") else var, mode, _TYPES.get(kind, str)(value) if mode != "d" else None)
    for r in a.rename:
        kind, old, new = r.split(",")
        ds = select.rename_dims(ds, {old: new}) if kind == "d" else select.rename_vars(ds, {old: new})
    if a.mangle:
        ds = select.mangle(ds)
    for m in a.mask:
        ds = select.mask_text(ds, m)
    for s in a.slice:
        ds = select.slice_text(ds, s)
    for r in a.reduce:
        dim, name, *weight = r.split(",")
        ds = reduce.weighted(ds, dim, weight[0], weight[0] if name == "mean" else None) if weight else reduce.apply_along(ds, **{dim: name})
    for m in a.mesh:
        dim, factor, name = m.split(",")
        ds = reduce.refine(ds, dim, round(1 / float(factor))) if float(factor) < 1 else reduce.coarsen(ds, dim, int(factor), name)
    for c in a.convolve:
        dim, mode, *w = c.split(",")
        ds = window.convolve(ds, dim, [float(x) for x in w], mode)
    for e in a.extract:
        ds = at_points(ds, e)
    return select.remove_singleton(ds) if a.remove_singleton else ds


def together(sets: list[Dataset], a: argparse.Namespace) -> list[Dataset]:
    """What a group's options make of its datasets taken together."""
    if a.stack:
        sets = [combine.stack(sets, a.stack)]
    if a.merge:
        sets = [combine.merge(sets)]
    if a.op_typ:
        n = len(a.op_typ) + 1
        if len(sets) < n:
            raise ValueError(f"{len(a.op_typ)} operators need {n} files; there are {len(sets)}")
        sets = [combine.sequence(a.op_typ, sets[:n]), *sets[n:]]
    for path in a.exprscript:
        with open(path, encoding="utf-8") as f:
            program = f.read()
        sets = [expr.evaluate(ds, program) for ds in sets]
    for e in a.expr:
        sets = [expr.evaluate(ds, e) for ds in sets]
    return sets


def datasets(spark: SparkSession, argv: Sequence[str]) -> tuple[list[Dataset], list[Group]]:
    """What all groups of a line give."""
    opened: dict[tuple, Dataset] = {}

    def open_(path: str, format: str | None) -> Dataset:
        if (path, format) not in opened:
            opened[path, format] = registry.open_dataset(spark, path, format)
        return opened[path, format]

    found: list[Dataset] = []
    parts = groups(argv)
    for g in parts:
        if g.a.files:
            found += together([prepare(open_(f, g.a.format), g.a) for f in g.a.files], g.a)
        else:
            found = together([prepare(ds, g.a) for ds in found], g.a)
    if not found:
        raise ValueError("no files")
    return found, parts


def run(spark: SparkSession, argv: Sequence[str]) -> Dataset | list[tuple]:
    action, *rest = argv
    if action not in ("dump", "gen", "eval"):
        raise ValueError(f"dump, gen or eval, not {action}")
    sets, parts = datasets(spark, rest)
    last = lambda name, other=None: next((getattr(g.a, name) for g in reversed(parts) if getattr(g.a, name)), other)
    if action == "eval":
        if len(sets) != 2:
            raise ValueError(f"eval compares two datasets, not {len(sets)}")
        names = last("funcs", "NO,NP,MO,MP,MB,RMSE,R2").split(",")
        rows = []
        for v in sets[0].data_vars():
            one = stats.evaluate(combine.paired(sets[0], sets[1], v), names).first()
            rows += [(v, n, one[n]) for n in names]
        return rows
    ds = fold(lambda x, y: x.merge(y), sets)
    if action == "gen":
        registry.save(ds, last("out"), last("out_format", "native"))
    else:
        print(ds.describe())
    return ds


if __name__ == "__main__":
    import sys

    from gridspark.session import get_spark

    found = run(get_spark(), sys.argv[1:])
    if isinstance(found, list):
        for row in found:
            print(",".join(map(str, row)))
